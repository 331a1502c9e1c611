import pytest
from pyspark.sql import functions as F

from foldwright.operators import experiments


@pytest.mark.parametrize("train,val,want", [
    (0.90, 0.89, "underfit"), (0.97, 0.95, "ok"), (0.99, 0.93, "overfit"), (0.99, 0.98, "ok"), (0.9699, 0.5, "underfit")])
def test_verdict(spark, train, val, want):
    df = spark.createDataFrame([(train, val)], "train_f1 double, val_f1 double")
    assert experiments.verdict(df).first()["verdict"] == want


@pytest.mark.parametrize("a,b,want", [
    ((0.95, 0.94), (0.96, 0.945), "accept"), ((0.95, 0.94), (0.96, 0.94), "accept"),
    ((0.95, 0.94), (0.96, 0.93), "reject_overfit"), ((0.95, 0.94), (0.94, 0.95), "no_gain"),
    ((0.95, 0.94), (0.95, 0.95), "no_gain")])
def test_decide_variant(spark, a, b, want):
    make = lambda r: spark.createDataFrame([("net", "knn", *r)], "backbone string, head string, mean double, min double")
    r = experiments.decide_variant(make(a), make(b), ["backbone", "head"]).first()
    assert r["decision"] == want and r["delta"] == pytest.approx(b[0] - a[0])


GRID = [("a", "knn", 0.9500, 0.002, 0.940), ("b", "knn", 0.9495, 0.002, 0.946), ("c", "knn", 0.9490, 0.002, 0.946),
        ("d", "mlp", 0.9400, 0.001, 0.949), ("e", "mlp", 0.9800, 0.050, 0.850)]
SCHEMA = "combo string, head string, mean double, std double, min double"


def test_pick_winner(spark):
    df = spark.createDataFrame(GRID, SCHEMA)
    r = experiments.pick_winner(df, max_std=0.01).first()
    assert (r["combo"], r["head"], r["min"]) == ("b", "knn", 0.946)  # equal min: higher mean
    assert experiments.pick_winner(df).first()["combo"] == "e"
    both = df.withColumn("task", F.lit("x")).unionByName(df.where("combo <> 'b'").withColumn("task", F.lit("y")))
    got = {r["task"]: r["combo"] for r in experiments.pick_winner(both, ["task"], max_std=0.01).collect()}
    assert got == {"x": "b", "y": "c"}
    assert [r["combo"] for r in experiments.rank_grid(df).collect()] == ["e", "a", "b", "c", "d"]


def replay(scores, patience):
    best, at, wait, last = 0.0, None, 0, None
    for i, s in enumerate(scores):
        last = i
        if s > best:
            best, at, wait = s, i, 0
        else:
            wait += 1
            if patience is not None and wait >= patience:
                return at, best, last, True
    return at, best, last, False


@pytest.mark.parametrize("patience", [None, 1, 3, 4])
def test_best_epoch(spark, patience):
    runs = {
        "plateau": [0.5, 0.7, 0.8, 0.8, 0.79, 0.8, 0.81, 0.8, 0.8, 0.8, 0.8, 0.9],
        "flat": [0.0] * 5, "falling": [0.9, 0.8, 0.7, 0.6, 0.5], "rising": [0.1 * i for i in range(1, 9)],
        "hot": [((i * 37) % 101) / 101 + (i // 50) / 100 for i in range(400)],
    }
    rows = [(r, 10 * i + 3, s) for r, xs in runs.items() for i, s in enumerate(xs)]  # epochs need not be consecutive
    df = spark.createDataFrame(rows, "run string, epoch int, val_f1 double").repartition(5)
    got = {r["run"]: r for r in experiments.best_epoch(df, patience).collect()}
    for name, xs in runs.items():
        at, best, last, stopped = replay(xs, patience)
        r = got[name]
        assert r["best_epoch"] == (None if at is None else 10 * at + 3)
        assert (r["best_score"], r["last_epoch"], r["stopped_early"]) == (best, 10 * last + 3, stopped), name


def test_best_epoch_by_run_and_fold(spark):
    rows = [("r", f, e, 0.1 * e + f) for f in range(2) for e in range(1, 5)]
    df = spark.createDataFrame(rows, "run string, fold int, epoch int, val_f1 double")
    got = {r["fold"]: (r["best_epoch"], r["stopped_early"]) for r in experiments.best_epoch(df, 2, ["run", "fold"]).collect()}
    assert got == {0: (4, False), 1: (4, False)}


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "run_name string, f1 double")
    new = spark.createDataFrame([("b", 3.0), ("c", 4.0)], "run_name string, f1 double")
    assert sorted(map(tuple, experiments.upsert_results(old, new).collect())) == [("a", 1.0), ("b", 3.0), ("c", 4.0)]
