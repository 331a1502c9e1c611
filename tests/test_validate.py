import numpy as np
import pytest
from cases import prob_rows
from pyspark.sql import functions as F

from foldwright.operators import validate, vectors

NAN, INF = float("nan"), float("inf")


def bad(report):
    return {r["check"]: r["n_bad"] for r in report.collect() if not r["ok"]}


GOOD = [(0, 0, 0, [0.7, 0.2, 0.1]), (1, 2, 1, [0.1, 0.1, 0.8]), (2, 1, 1, [0.2, 0.6, 0.2])]


@pytest.mark.parametrize("row,want", [
    ((3, 0, 0, [NAN, 0.5, 0.5]), {"finite": 1}), ((3, 0, 0, [INF, 0.5, 0.5]), {"finite": 1}),
    ((3, 0, 0, [0.5, 0.5, 0.5]), {"sums_to_one": 1}), ((3, 0, 0, [0.5, 0.5]), {"length_k": 1, "finite": 1}),
    ((3, 0, 0, [0.5, 0.3, 0.2009]), {}), ((3, 0, 0, [0.5, 0.3, 0.202]), {"sums_to_one": 1}),
    ((3, 5, 0, [0.5, 0.3, 0.2]), {"label_known": 1}), ((3, None, 0, [0.5, 0.3, 0.2]), {"label_known": 1}),
    ((2, 1, 1, [0.2, 0.6, 0.2]), {"key_once": 1}), ((3, 0, 0, None), {"length_k": 1, "finite": 1})])
def test_probs(spark, row, want):
    assert bad(validate.validate_probs(prob_rows(spark, GOOD))) == {}
    assert bad(validate.validate_probs(prob_rows(spark, [*GOOD, row]))) == want


def test_prob_coverage(spark):
    df = prob_rows(spark, GOOD)
    want = spark.createDataFrame([(0,), (1,), (7,)], "key bigint")
    assert bad(validate.validate_probs(df, expected=want)) == {"every_key_present": 1, "no_unknown_key": 1}


def vecs(spark, rows):
    return spark.createDataFrame(rows, "key string, vec array<float>")


def test_vectors(spark):
    good = [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    assert bad(validate.validate_vectors(vecs(spark, good), 2)) == {}
    assert bad(validate.validate_vectors(vecs(spark, good), 3)) == {"row_count": 1}
    assert bad(validate.validate_vectors(vecs(spark, [*good, ("c", [NAN, 1.0])]))) == {"finite": 1}
    assert bad(validate.validate_vectors(vecs(spark, [*good, ("c", [1.0])]))) == {"constant_length": 1}


def sub(spark, rows, names="pos bigint, id string, predicted int"):
    return spark.createDataFrame(rows, names)


TEMPLATE = [(0, "x"), (1, "y"), (2, "z")]


@pytest.mark.parametrize("rows,want", [
    ([(0, "x", 0), (1, "y", 2), (2, "z", 1)], set()),
    ([(0, "x", 0), (1, "y", 2)], {"row_count"}),
    ([(0, "x", 0), (1, "y", 3), (2, "z", 1)], {"known_class"}),
    ([(0, "x", 0), (1, "y", None), (2, "z", 1)], {"no_nulls"}),
    ([(0, "y", 0), (1, "x", 2), (2, "z", 1)], {"id_order"}),
    ([(0, "y", 9), (1, "x", None)], {"row_count", "id_order", "known_class", "no_nulls"})])
def test_submission(spark, rows, want):
    template = spark.createDataFrame(TEMPLATE, "pos bigint, id string")
    assert set(bad(validate.validate_submission(sub(spark, rows), template))) == want


def test_submission_columns(spark):
    template = spark.createDataFrame(TEMPLATE, "pos bigint, id string")
    rows = sub(spark, [(i, n, 0) for i, n in TEMPLATE]).withColumn("extra", F.lit(1))
    assert bad(validate.validate_submission(rows, template)) == {"columns": 1}


SHARD = "start bigint, end bigint, n_rows bigint"


@pytest.mark.parametrize("rows,want", [
    ([(3, 6, 3), (0, 3, 3), (6, 8, 2)], set()),
    ([(0, 3, 3), (6, 8, 2)], {"total_rows", "no_gap"}),
    ([(0, 3, 3), (2, 5, 3), (6, 8, 2)], {"no_gap"}),
    ([(0, 3, 3), (0, 3, 3), (3, 8, 5)], {"total_rows", "no_repeated_start"}),
    ([(0, 3, 2), (3, 8, 6)], {"rows_match_range"}),
    ([(1, 8, 7)], {"total_rows", "covers_range", "no_gap"})])
def test_shards(spark, rows, want):
    assert set(bad(validate.validate_shards(spark.createDataFrame(rows, SHARD), 8))) == want


def test_label_map_weights_counts(spark):
    df = spark.createDataFrame([(0, "Recyclable"), (2, "Organic")], "label int, label_name string")
    names = ["Recyclable", "Electronic", "Organic"]
    assert bad(validate.validate_label_map(df, names)) == {}
    assert bad(validate.validate_label_map(df, names[::-1])) == {"label_map": 2}
    w = spark.createDataFrame([(0, 0.88), (1, 2.2), (2, 0.7)], "label int, weight double")
    assert bad(validate.validate_weights(w, heaviest=1)) == {}
    assert bad(validate.validate_weights(w, heaviest=2)) == {"heaviest_class": 1}
    assert bad(validate.validate_weights(w.where("label < 2"))) == {"one_per_class": 1}
    assert bad(validate.expect_count(w, 3)) == {} and bad(validate.expect_count(w, 5)) == {"row_count": 2}


def test_stability_and_combine(spark):
    before = spark.createDataFrame([("a", 0), ("b", 1)], "key string, fold int")
    after = spark.createDataFrame([("a", 1), ("c", 1)], "key string, fold int")
    report = validate.combine({"x": validate.validate_fold_stability(after, before),
                               "y": validate.validate_fold_stability(before, before)})
    assert {(r["artefact"], r["check"]) for r in report.collect() if not r["ok"]} == {
        ("x", "fold_unchanged"), ("x", "no_new_key")}
    with pytest.raises(ValueError):
        validate.assert_ok(report)


def test_alignment(spark):
    folds = spark.createDataFrame([("a", 0), ("b", 1)], "key string, fold int")
    rows = vectors.align_vectors(vecs(spark, [("b", [1.0]), ("a", [2.0]), ("z", [3.0])]), folds)
    assert {r["key"]: r["vec"] for r in rows.collect()} == {"a": [2.0], "b": [1.0]}
    with pytest.raises(ValueError, match="every_key_has_a_vector: 1"):
        vectors.align_vectors(vecs(spark, [("a", [1.0])]), folds)
    with pytest.raises(ValueError, match="vector_keys_unique"):
        vectors.align_vectors(vecs(spark, [("a", [1.0]), ("a", [1.0]), ("b", [1.0])]), folds)
    ids = spark.createDataFrame([("a",), ("q",)], "id string")
    assert bad(vectors.template_alignment(folds.withColumnRenamed("key", "id"), ids)) == {
        "no_missing_vector": 1, "no_extra_vector": 1}


def test_key_columns(spark):
    a = spark.createDataFrame([("/d//x/",)], "path string")
    assert vectors.common_key(a, a) == "path"
    assert vectors.normalize_key(a, "path").first()["key"] == "/d/x"
    with pytest.raises(KeyError):
        vectors.common_key(a, a.withColumnRenamed("path", "other"))


def test_blocks_views_and_ensembles(spark):
    a, b = vecs(spark, [("a", [3.0, 4.0]), ("b", [0.0, 0.0])]), vecs(spark, [("b", [0.0, 5.0]), ("a", [2.0, 0.0])])
    got = {r["key"]: r["vec"] for r in vectors.join_blocks([a, b]).collect()}
    assert np.allclose(got["a"], [0.6, 0.8, 1, 0]) and np.allclose(got["b"], [0, 0, 0, 1])
    with pytest.raises(Exception, match="same keys"):
        vectors.join_blocks([a, b.where("key = 'a'")]).collect()
    assert {r["key"]: r["vec"] for r in vectors.average_views([a, b]).collect()}["a"] == [2.5, 2.0]

    p = prob_rows(spark, [(0, 0, 0, [1.0, 0.0, 0.0])])
    q = prob_rows(spark, [(0, 0, 0, [0.0, 1.0, 0.0])])
    assert vectors.ensemble({"p": p, "q": q}).first()["probs"] == [0.5, 0.5, 0.0]
    assert vectors.ensemble({"p": p, "q": q}, {"p": 3, "q": 1}).first()["probs"] == [0.75, 0.25, 0.0]
    with pytest.raises(KeyError):
        vectors.ensemble({"p": p, "q": q}, {"p": 1})
