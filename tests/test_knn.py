import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwright.operators import knn, metrics


def vec_rows(spark, x, label, fold):
    rows = [(i, int(fold[i]), int(label[i]), [float(v) for v in x[i]]) for i in range(len(x))]
    return spark.createDataFrame(rows, "key bigint, fold int, label int, vec array<double>").cache()


def brute(x, label, fold, k, n_classes):
    u = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    d = np.clip(1 - u @ u.T, 0, 2)
    d[d < 1e-12] = 0
    d[fold[:, None] == fold[None, :]] = np.inf
    out = np.zeros((len(x), n_classes))
    for i in range(len(x)):
        near = np.argsort(d[i], kind="stable")[:k]
        near = near[np.isfinite(d[i, near])]
        exact = near[d[i, near] == 0]
        w = np.ones(len(exact)) if len(exact) else 1 / d[i, near]
        for j, v in zip(exact if len(exact) else near, w):
            out[i, label[j]] += v
    return out / out.sum(1, keepdims=True)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    n = 300
    label, fold = np.arange(n) % 3, np.arange(n) % 5
    x = rng.normal(0, 5, (3, 8))[label] + rng.normal(0, 4, (n, 8))
    x[:100] = x[0]  # a third of all vectors identical
    return vec_rows(spark, x, label, fold), x, label, fold


@pytest.mark.parametrize("block_rows", [10_000, 64, 17])
def test_equals_brute_force(data, block_rows):
    df, x, label, fold = data
    got = {r["key"]: r["probs"] for r in knn.knn_oof(df.repartition(3), 3, 15, block_rows).collect()}
    want = brute(x, label, fold, 15, 3)
    assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-9)


def test_neighbours_never_share_the_fold(data):
    df = data[0]
    fold = {r["key"]: r["fold"] for r in df.collect()}
    rows = knn.knn_join(df, df, 15, 100, exclude_same_fold=True).collect()
    assert len(rows) == 300 * 15 and all(fold[r["q_key"]] != fold[r["t_key"]] for r in rows)


def test_random_vectors_teach_nothing(spark):
    """Leakage check: no signal in, no skill out."""
    rng = np.random.default_rng(0)
    label, fold = rng.integers(0, 3, 300), np.arange(300) % 5
    df = vec_rows(spark, rng.normal(size=(300, 10)), label, fold)
    oof = metrics.with_pred(knn.knn_oof(df, 3))
    assert oof.where("pred = label").count() / 300 < 0.6


def test_separable(spark):
    rng = np.random.default_rng(42)
    label, fold = np.arange(150) % 3, np.arange(150) % 5
    df = vec_rows(spark, rng.normal(0, 5, (3, 10))[label] + rng.normal(0, 0.3, (150, 10)), label, fold)
    assert metrics.fold_scores(metrics.with_pred(knn.knn_oof(df, 3))).agg({"macro_f1": "min"}).first()[0] > 0.9


def test_few_train_rows(spark):
    train = vec_rows(spark, np.eye(3), [0, 1, 2], [0, 0, 0])
    test = vec_rows(spark, np.array([[1.0, 0, 0], [1, 1, 0], [0, 0, 0]]), [0] * 3, [0] * 3)
    got = {r["key"]: r["probs"] for r in knn.knn_predict(train, test, 3).collect()}
    assert got[0] == [1, 0, 0] and got[1][0] == pytest.approx(got[1][1]) and sum(got[2]) == pytest.approx(1)


def test_far_cells_are_skipped(spark):
    """Well separated clusters: a query's blocks stay near its own cluster, and results are exact."""
    rng = np.random.default_rng(7)
    label, fold = np.arange(600) % 6, (np.arange(600) // 6) % 5
    x = np.eye(6)[label] * 10 + rng.normal(0, 0.05, (600, 6))
    df = vec_rows(spark, x, label, fold)
    got = {r["key"]: r["probs"] for r in knn.knn_oof(df, 6, 5, block_rows=20).collect()}
    assert np.allclose([got[i] for i in range(600)], brute(x, label, fold, 5, 6), atol=1e-9)

    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    pivots, per = units[:6], np.full(7, 100)
    per[6] = 0
    run = knn._cells_needed(pivots, np.array([0.1] * 6 + [0.0]), {None: per}, 5, np.arange(7), np.ones(7, dtype=int))
    import pandas as pd
    out = next(run(iter([pd.DataFrame({"q_key": [0], "q_vec": [x[0]], "q_fold": [0]})])))
    assert out["home"][0] == 0 and list(out["blocks"][0]) == [0]


def test_zero_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4))
    x[::7] = 0
    label, fold = np.arange(120) % 3, np.arange(120) % 5
    df = vec_rows(spark, x, label, fold)
    got = {r["key"]: r["probs"] for r in knn.knn_oof(df, 3, 15, 16).collect()}
    assert np.allclose([got[i] for i in range(120)], brute(x, label, fold, 15, 3), atol=1e-9)


def test_all_zero_and_copies(spark):
    df = vec_rows(spark, np.zeros((40, 3)), np.arange(40) % 2, np.arange(40) % 4)
    rows = knn.knn_join(df, df, 3, 8, exclude_same_fold=True).collect()
    assert len(rows) == 120 and all(r["dist"] == 1.0 for r in rows)
    assert {r["t_key"] for r in rows if r["q_key"] == 39} == {0, 1, 2}
    assert {r["t_key"] for r in rows if r["q_key"] == 0} == {1, 2, 3}


def test_cells_of_a_large_table_are_searched_in_packs(spark, monkeypatch):
    """Many cells and packs, no clusters, keys that are strings: exact, and no vector is copied for pairs of blocks."""
    monkeypatch.setattr(knn, "PACK_ENTRIES", 6 * 300)
    rng = np.random.default_rng(11)
    x, label, fold = rng.normal(size=(1500, 6)), rng.integers(0, 3, 1500), np.arange(1500) % 5
    x[7::50] = x[7]
    x[9::90] = 0
    df = vec_rows(spark, x, label, fold).withColumn("key", F.format_string("k%05d", "key"))
    near = knn.knn_join(df, df, 5, block_rows=16, exclude_same_fold=True)
    plan = near._jdf.queryExecution().toString()
    assert "CoGroups" not in plan and "explode" not in plan
    u = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    d = 1 - u @ u.T
    d[fold[:, None] == fold[None, :]] = np.inf
    got = {}
    for r in near.collect():
        got.setdefault(int(r["q_key"][1:]), []).append((r["dist"], int(r["t_key"][1:]), r["t_label"]))
    assert len(got) == 1500
    for i, rows in got.items():
        rows.sort()
        assert np.allclose([dist for dist, _, _ in rows], np.sort(d[i])[:5], atol=1e-9)
        assert all(fold[j] != fold[i] and label[j] == c and abs(d[i, j] - dist) < 1e-9 for dist, j, c in rows)
        for dist, j, _ in rows:  # equal distances are won by the smaller key
            assert not [m for m in np.flatnonzero(np.all(x == x[j], axis=1) & (fold != fold[i])) if m < j and m not in [b for _, b, _ in rows]]


def test_a_query_of_many_cells_carries_one_number(spark):
    """What a query takes along does not grow with the cells it may need: lists of blocks filled an executor's memory."""
    rng = np.random.default_rng(12)
    pivots = rng.normal(size=(400, 8))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    per = rng.integers(0, 3, 401)
    radius = np.append(np.full(400, 0.2), 0.0)
    q = rng.normal(size=(30, 8))
    out = next(knn._cells_needed(pivots, radius, {None: per}, 40)(iter([pd.DataFrame({"q_key": range(30), "q_vec": list(q), "q_fold": [0] * 30})])))
    assert set(out.columns) == {"q_key", "q_vec", "q_fold", "home", "bound"}
    away = np.sqrt(2 - 2 * (q / np.linalg.norm(q, axis=1, keepdims=True)) @ pivots.T) + 0.2
    away = np.hstack([away, np.full((30, 1), np.sqrt(2))])
    for i in range(30):
        order = np.argsort(away[i])
        assert np.isclose(out["bound"][i], away[i, order[np.argmax(per[order].cumsum() >= 40)]])


def test_out_of_fold_without_arrow_conversion(spark):
    """A session's default setting: tables made on the driver get wider integers then, and cells must still meet."""
    rng = np.random.default_rng(13)
    label, fold = rng.integers(0, 3, 400), np.arange(400) % 5
    x = rng.normal(size=(400, 6))
    df = vec_rows(spark, x, label, fold)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else a small table is one partition
    try:
        got = {r["key"]: r["probs"] for r in knn.knn_oof(df, 3, 15, 16).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert np.allclose([got[i] for i in range(400)], brute(x, label, fold, 15, 3), atol=1e-9)
