"""Rows that cannot be counted or matched are errors; nothing is dropped unreported."""

import numpy as np
import pytest

from foldwright.operators import knn, label_noise, splits, tuning, vectors
from foldwright.plans import decide
from foldwright.sources import tables

GOOD = [(k, k % 3, k % 2, [0.2, 0.3, 0.5]) for k in range(12)]


def rows(spark, extra=()):
    return spark.createDataFrame([*GOOD, *extra], "key bigint, label int, fold int, probs array<double>")


@pytest.mark.parametrize("bad", [
    (99, 3, 0, [0.2, 0.3, 0.5]), (99, -1, 0, [0.2, 0.3, 0.5]), (99, None, 0, [0.2, 0.3, 0.5]), (99, 1, None, [0.2, 0.3, 0.5]),
    (99, 1, 0, [0.2, float("nan"), 0.1]), (99, 1, 0, [0.2, float("inf"), 0.1]), (99, 1, 0, [0.2, None, 0.1]), (99, 1, 0, [0.2, 0.8])])
def test_tuning_rejects_what_it_cannot_count(spark, bad):
    grid = [[1.0, 1.0, 1.0], [1.0, 2.0, 1.0]]
    assert tuning.tune_multipliers(rows(spark), grid).count() == 1
    with pytest.raises(Exception, match="cannot tune on a row"):
        tuning.tune_multipliers(rows(spark, [bad]), grid).collect()
    both = rows(spark, [bad]).selectExpr("*", "probs AS probs2")
    with pytest.raises(Exception, match="cannot tune on a row"):
        tuning.nested_weight_search(both, ["probs", "probs2"], n=3)


def test_ensemble_needs_the_same_keys(spark):
    a, b = rows(spark), rows(spark).select("key", "probs")
    assert vectors.ensemble({"a": a, "b": b}).count() == len(GOOD)
    for sets in ({"a": a, "b": b.where("key <> 4")}, {"a": a.where("key <> 4"), "b": b}):
        with pytest.raises(Exception, match="same keys: 4"):
            vectors.ensemble(sets).collect()


def test_views_need_the_same_keys(spark):
    a = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "key bigint, vec array<double>")
    assert vectors.average_views([a, a, a]).count() == 5
    with pytest.raises(Exception, match="same keys: 2"):
        vectors.average_views([a, a.where("key <> 2")]).collect()


def test_issues_need_metadata(spark):
    issues = spark.createDataFrame([(1, 0.5), (2, 0.5)], "key bigint, margin double")
    folds = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "key bigint, fold int")
    assert label_noise.attach_metadata(issues, folds).count() == 2
    with pytest.raises(Exception, match="no metadata for issue 2"):
        label_noise.attach_metadata(issues, folds.where("key <> 2")).collect()


def test_groups_may_not_be_null(spark):
    df = spark.createDataFrame([(k, k % 2, f"g{k // 3}") for k in range(60)], "key bigint, label int, group string")
    assert splits.stratified_group_kfold(df, n_classes=2).count() == 60
    with pytest.raises(Exception, match="no group"):
        splits.stratified_group_kfold(df.union(spark.createDataFrame([(99, 0, None)], df.schema)), n_classes=2).collect()


def test_decide_needs_whole_sets(spark):
    a = rows(spark)
    template = a.selectExpr("key AS pos", "key AS id")
    tests = {"a": a.select("key", "probs"), "b": a.select("key", "probs")}
    grid = [[1.0, 1.0, 1.0], [1.0, 2.0, 1.0]]
    assert decide.decide({"a": a, "b": a}, tests, template, grid=grid).submission.count() == len(GOOD)
    with pytest.raises(Exception, match="same keys"):
        decide.decide({"a": a, "b": a.where("key <> 3")}, tests, template, grid=grid)


def test_equal_groups_are_dealt_as_one_by_one():
    """The bulk step of group folds against the rule taken group by group."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        start, step, n = [int(x) for x in rng.integers(0, 40, 5)], int(rng.integers(1, 9)), int(rng.integers(0, 60))
        load, want = list(start), [0] * 5
        for _ in range(n):
            f = load.index(min(load))
            load[f] += step
            want[f] += 1
        assert splits._dealt(start, step, n) == want


def test_dense_cell_asked_by_many_blocks(spark):
    """Most rows in one narrow cell, which every query block needs: still exact."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.array([1.0, 0, 0, 0]) + rng.normal(0, 1e-3, (500, 4)), rng.normal(0, 1, (100, 4))])
    df = spark.createDataFrame([(k, [float(v) for v in r], k % 2) for k, r in enumerate(x)], "key bigint, vec array<double>, label int")
    got = {}
    for r in knn.knn_join(df, df, 3, block_rows=40).collect():
        got.setdefault(r["q_key"], {})[r["t_key"]] = r["dist"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.clip(1 - u @ u.T, 0, 2)
    d[d < 1e-12] = 0
    for k in range(len(x)):
        best = np.sort(d[k])[:3]
        assert np.allclose(sorted(got[k].values()), best, atol=1e-9)
