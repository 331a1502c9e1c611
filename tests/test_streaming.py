"""Row-local operators and checks give on a stream what they give on the table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.functions import paths, probs, vectors
from foldwright.operators import diagnosis, metrics, review, tuning, validate
from foldwright.operators.vectors import l2_normalise
from foldwright.streaming import checks

SCHEMA = "key bigint, label int, fold int, probs array<double>, vec array<double>, path string, csv_row int, quality double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Five files of labelled rows, some of them broken."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        p = rng.dirichlet([1, 1, 1])
        p = {7: [0.5, 0.5], 8: None, 9: [0.9, 0.9, 0.9], 10: [float("nan"), 0.5, 0.5]}.get(i % 50, [float(x) for x in p])
        v = {3: [1.0, float("inf"), 0.0, 0.0], 4: None, 5: [1.0], 6: [0.0] * 4}.get(i % 60, [float(x) for x in rng.normal(size=4)])
        rows.append((i if i % 40 else 0, [0, 1, 2, 3, None][min(i % 29, 4)] if i % 29 < 5 else i % 3, i % 5, p, v, f"/data\\\\train//class {i % 3}/img{i}.JPG", i, float(rng.random())))
    path = str(tmp_path_factory.mktemp("stream") / "in")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return path


def good(df):
    return df.where("size(probs) = 3 AND NOT isnan(probs[0]) AND label BETWEEN 0 AND 2")


OPERATORS = {
    "F argmax, top, margin, entropy": lambda df: good(df).select("key", probs.argmax("probs"), probs.top1("probs"), probs.top2("probs"), probs.margin("probs"),
                                                                 probs.entropy_norm("probs"), probs.entropy_clip("probs")),
    "F scaled, softmax, blends": lambda df: good(df).select("key", probs.scale_argmax("probs", [1.0, 2.0, 0.5]), probs.softmax("probs"),
                                                            probs.mean_probs(["probs", "probs"]), probs.blend_probs(["probs", "probs"], [0.3, 0.7])),
    "F names, ids, rounding": lambda df: good(df).select("key", probs.class_name("label", ["a", "b", "c"]), probs.half_even("quality", 3)),
    "F vectors": lambda df: df.where("size(vec) = 4").select("key", vectors.l2norm("vec"), vectors.squared_norm("vec"), vectors.cosine("vec", F.reverse("vec")),
                                                             vectors.concat_features(["vec", "vec"]), vectors.vec_mean(["vec", "vec"]), vectors.is_finite("vec")),
    "F paths, hashes": lambda df: df.select("key", paths.normalize_path("path"), paths.file_name("path"), paths.suffix("path"), paths.rebase("path", "/data", "/new"),
                                            paths.short_digest("path"), paths.hamming(F.col("key"), F.lit(5).cast("bigint"))),
    "B7 severity": lambda df: diagnosis.diagnose(good(df)).select("key", review.review_severity()),
    "B8 caption": lambda df: diagnosis.diagnose(good(df)).join(df.sparkSession.createDataFrame([(i, 0.5) for i in range(400)], "key bigint, quality double"), "key")
    .withColumn("csv_row", F.col("key").cast("int")).select("key", review.review_caption()),
    "B9 pair label, priority": lambda df: diagnosis.diagnose(good(df)).select("key", diagnosis.pair_label("label", "pred_class"),
                                                                              diagnosis.is_priority(F.col("label"), F.col("pred_class"))),
    "I1 diagnose": lambda df: diagnosis.diagnose(good(df)),
    "I2 label quality": lambda df: good(df).select("key", probs.label_quality("probs", "label")),
    "J2 multipliers": lambda df: tuning.apply_multipliers(good(df), [1.0, 1.2, 0.8]).select("key", "predicted"),
    "predictions": lambda df: metrics.with_pred(good(df)).select("key", "pred"),
    "unit vectors": lambda df: l2_normalise(df.where("size(vec) = 4")).select("key", "vec"),
    "H1 row checks": lambda df: validate.broken_rows(df, validate.prob_rules(3)).select("key", "broken"),
    "H2 row checks": lambda df: validate.broken_rows(df, validate.vector_rules(4)).select("key", "broken"),
}


def streamed(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_stream_equals_batch(spark, folder, tmp_path, name):
    def named(df):
        return df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    out = str(tmp_path / "out")
    query = (named(OPERATORS[name](streamed(spark, folder))).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    want = named(OPERATORS[name](spark.read.schema(SCHEMA).parquet(folder)))
    got = spark.read.schema(want.schema).parquet(out)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() > 0


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_watched_table_gives_the_batch_report(spark, folder, tmp_path):
    """Counts by micro-batch add up to the validators' report; going on with new files and running again change nothing twice."""
    table = spark.read.schema(SCHEMA).parquet(folder)
    out = str(tmp_path / "p")
    for _ in range(2):
        checks.watch_probs(streamed(spark, folder), out, str(tmp_path / "pc")).awaitTermination()
        assert rows(checks.probs_report(spark, out)) == rows(validate.validate_probs(table))
    assert {r["check"]: r["n_bad"] for r in checks.probs_report(spark, out).collect()}["key_once"] > 0
    assert spark.read.parquet(f"{out}/counts").count() == 5
    out = str(tmp_path / "v")
    checks.watch_vectors(streamed(spark, folder), out, str(tmp_path / "vc")).awaitTermination()
    assert rows(checks.vectors_report(spark, out, 399)) == rows(validate.validate_vectors(table, 399))


def test_a_replayed_batch_counts_once(spark, folder, tmp_path):
    """A checkpoint that lost its last commit runs the batch again: it writes over what it had written."""
    import os
    out, cp = str(tmp_path / "p"), str(tmp_path / "pc")
    checks.watch_probs(streamed(spark, folder), out, cp).awaitTermination()
    want = rows(checks.probs_report(spark, out))
    for name in ("4", ".4.crc"):
        if os.path.exists(f"{cp}/commits/{name}"):
            os.replace(f"{cp}/commits/{name}", str(tmp_path / f"gone{name}"))
    checks.watch_probs(streamed(spark, folder), out, cp).awaitTermination()
    assert rows(checks.probs_report(spark, out)) == want
