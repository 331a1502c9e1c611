import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.operators import metrics, profile


def labelled(spark, y, p, fold=None):
    rows = [(int(a), int(b), int(f)) for a, b, f in zip(y, p, fold if fold is not None else [0] * len(y))]
    return spark.createDataFrame(rows, "label int, pred int, fold int")


def f1s(y, p, k=3):
    out = []
    for c in range(k):
        tp, n = sum((y == c) & (p == c)), sum(y == c) + sum(p == c)
        out.append(2 * tp / n if n else 0.0)
    return np.array(out)


def test_perfect(spark):
    assert metrics.macro_f1(labelled(spark, [0, 1, 2], [0, 1, 2])).first()[0] == 1.0


def test_missing_class_counts_zero(spark):
    df = labelled(spark, [0, 1, 2], [0, 0, 2])
    assert metrics.macro_f1(df).first()[0] == pytest.approx((2 / 3 + 0 + 1) / 3)
    single = labelled(spark, [0, 0], [0, 0])
    assert metrics.macro_f1(single).first()[0] == pytest.approx(1 / 3)
    assert metrics.macro_f1(single, observed=True).first()[0] == 1.0


def test_confusion_is_always_square(spark):
    df = labelled(spark, [0, 0], [0, 0])
    cells = {(r["label"], r["pred"]): r["n"] for r in metrics.confusion(df).collect()}
    assert len(cells) == 9 and cells[(0, 0)] == 2 and sum(cells.values()) == 2
    shares = {(r["label"], r["pred"]): r["share"] for r in metrics.confusion_normalised(df).collect()}
    assert shares[(0, 0)] == 1.0 and shares[(1, 0)] is None


def test_folds(spark):
    rng = np.random.default_rng(1)
    y, p, f = rng.integers(0, 3, 300), rng.integers(0, 3, 300), np.arange(300) % 5
    df = labelled(spark, y, p, f)
    want = [f1s(y[f == i], p[f == i]).mean() for i in range(5)]
    got = {r["fold"]: r["macro_f1"] for r in metrics.fold_scores(df).collect()}
    assert [got[i] for i in range(5)] == pytest.approx(want)
    c = metrics.fold_consistency(df).first()
    assert (c["mean"], c["std"], c["min"]) == pytest.approx((np.mean(want), np.std(want), np.min(want)))
    s = metrics.cv_summary(df).first()
    assert s["cv_std"] == pytest.approx(np.std(want, ddof=1))
    assert s["oof_overall"] == pytest.approx(f1s(y, p).mean())
    assert s["consistent"] == (abs(np.mean(want) - f1s(y, p).mean()) < 0.05)


def test_error_rates_flag_an_odd_fold(spark):
    y = [0, 1, 2] * 4
    even = labelled(spark, y, y, [0] * 6 + [1] * 6)
    assert not any(r["uneven"] for r in metrics.fold_error_rates(even).collect())
    odd = labelled(spark, y, [0] * 6 + y[6:], [0] * 6 + [1] * 6)
    assert all(r["uneven"] for r in metrics.fold_error_rates(odd).collect())


def test_action_table(spark):
    y = [0] * 10 + [1] * 10 + [2] * 10
    p = [0] * 10 + [1] * 7 + [0] * 3 + [2] * 10
    rows = {r["class_id"]: r for r in metrics.class_action_table(labelled(spark, y, p)).collect()}
    assert rows[1]["missed_as"] == "Recyclable" and rows[1]["n_missed"] == 3
    assert rows[1]["advice"] == "low_recall_lower_threshold"
    assert rows[0]["taken_from"] == "Electronic" and rows[0]["advice"] == "low_precision_raise_threshold"
    assert rows[0]["missed_as"] == "Electronic" and rows[0]["n_missed"] == 0  # first of a tie
    assert rows[2]["advice"] == "at_target" and rows[2]["gap_to_target"] == 0


def test_weights_and_distribution(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 3, "label int")
    w = {r["label"]: r["weight"] for r in profile.class_weights(df).collect()}
    assert w == {0: 0.5, 1: 1.0, 2: float("inf")}
    d = {r["label"]: (r["n"], r["share"]) for r in profile.class_distribution(df).collect()}
    assert d[2] == (0, 0.0) and d[0] == (6, pytest.approx(2 / 3))
    mix = {r["predicted"]: r["too_rare"] for r in profile.prediction_mix(df, pred="label").collect()}
    assert mix == {0: False, 1: False, 2: True}


def test_published_class_weights(spark):
    """Counts 9808 / 3933 / 12244 give the published weights."""
    n = {0: 9808, 1: 3933, 2: 12244}
    df = spark.range(sum(n.values())).select(
        F.when(F.col("id") < n[0], 0).when(F.col("id") < n[0] + n[1], 1).otherwise(2).alias("label"))
    w = [r["weight"] for r in profile.class_weights(df).orderBy("label").collect()]
    assert w == pytest.approx([0.8831226209896683, 2.202305280108484, 0.7074213220080584], rel=1e-14)


def test_histogram_last_bin_closed(spark):
    v = [0.0, 0.1, 0.5, 0.99, 1.0]
    df = spark.createDataFrame([(x, 0) for x in v], "v double, label int")
    for by in (None, "label"):
        rows = {r["bin"]: r["n"] for r in profile.histogram(df, "v", 4, by).collect()}
        want, _ = np.histogram(v, 4)
        assert [rows.get(i, 0) for i in range(4)] == want.tolist()


def test_size_summary(spark):
    df = spark.createDataFrame([(10, 5, 3), (21, 8, 3), (30, 9, 1), (40, 1, 4)], "width int, height int, channels int")
    r = profile.size_summary(df).first()
    assert (r["width_min"], r["width_max"], r["width_median"], r["height_median"]) == (10, 40, 25, 6)
    assert r["channels"] == "1,3,4"


def test_drop_cap():
    assert profile.drop_cap(795, 26527, 3) and not profile.drop_cap(796, 26527, 3)


def test_table_digest_ignores_order(spark):
    df = spark.range(100).withColumn("s", F.col("id").cast("string"))
    a = profile.table_digest(df.repartition(7)).first()
    assert a == profile.table_digest(df.orderBy(F.desc("id"))).first()
    assert a != profile.table_digest(df.withColumn("s", F.lit("x"))).first()
