import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.operators import splits, validate


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    n = 3000
    label = rng.choice(3, n, p=[0.38, 0.15, 0.47])
    group = np.where(rng.random(n) < 0.3, 0, np.where(rng.random(n) < 0.2, rng.integers(1, 60, n), np.arange(n) + 1000))
    return spark.createDataFrame(
        [(i, int(label[i]), int(group[i])) for i in range(n)], "key bigint, label int, group bigint").cache()


def test_stratified_counts_differ_by_one(rows):
    out = splits.stratified_kfold(rows, 5, 42)
    assert out.count() == 3000
    cells = out.groupBy("label").pivot("fold", list(range(5))).count().collect()
    for r in cells:
        assert max(r[1:]) - min(r[1:]) <= 1


def test_stratified_is_repeatable(rows):
    a = {r["key"]: r["fold"] for r in splits.stratified_kfold(rows.repartition(1), 5, 42).collect()}
    assert a == {r["key"]: r["fold"] for r in splits.stratified_kfold(rows.repartition(17), 5, 42).collect()}
    assert a != {r["key"]: r["fold"] for r in splits.stratified_kfold(rows, 5, 43).collect()}


def test_groups_stay_whole(rows):
    out = splits.stratified_group_kfold(rows, 5, 42).cache()
    assert out.count() == 3000 and out.select("key").distinct().count() == 3000
    assert splits.fold_overlap(out, "group").count() == 0
    again = splits.stratified_group_kfold(rows.repartition(13), 5, 42)
    assert again.join(out.select("key", F.col("fold").alias("f")), "key").where("fold <> f").count() == 0


def test_group_folds_are_balanced(rows):
    """The hot group fills one fold; the others share the rest evenly and keep the class shares."""
    out = splits.stratified_group_kfold(rows, 5, 42)
    per = out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[
        F.avg((F.col("label") == c).cast("double")).alias(f"s{c}") for c in range(3)]).collect()
    sizes = sorted(r["n"] for r in per)
    assert sizes[-1] < 1050 and sizes[-2] - sizes[0] < 60
    for r in per:
        assert [r["s0"], r["s1"], r["s2"]] == pytest.approx([0.38, 0.15, 0.47], abs=0.05)


def test_group_folds_without_large_groups(rows):
    single = rows.withColumn("group", F.col("key"))
    sizes = [r["count"] for r in splits.stratified_group_kfold(single, 5).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 6


def test_split_and_exclude(rows):
    folds = splits.stratified_kfold(rows)
    train, val = splits.split_fold(folds, 2)
    assert train.count() + val.count() == 3000 and train.join(val, "key").count() == 0
    assert splits.exclude(rows, val).count() == train.count()


def test_overlap_is_found(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2), ("b", 2)], "key string, fold int")
    assert [tuple(r) for r in splits.fold_overlap(df).collect()] == [("a", 2)]
    report = validate.validate_folds(df.withColumn("label", F.lit(0)))
    bad = {r["check"] for r in report.collect() if not r["ok"]}
    assert bad == {"no_fold_overlap", "key_once", "classes_in_every_fold"}


def test_samples(rows):
    out = splits.sample_per_class(rows, 5)
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 5, 1: 5, 2: 5}
    a = {r["key"] for r in splits.seeded_sample(rows.repartition(3), 50).collect()}
    assert len(a) == 50 and a == {r["key"] for r in splits.seeded_sample(rows.repartition(11), 50).collect()}
