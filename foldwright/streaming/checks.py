"""Data checks over a growing table with Structured Streaming.

Every micro-batch leaves one row of counts and its distinct keys, in folders named by the batch, which a replayed batch writes over;
so a crash neither loses nor doubles anything. The report over all batches is that of the batch validators.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foldwright.operators.single import beside
from foldwright.operators.validate import prob_rules, report, vector_rules


def watch(stream: DataFrame, rules: Mapping[str, Column], out: str, checkpoint: str, key: str | None = "key", vec: str | None = None,
          available_now: bool = True) -> StreamingQuery:
    """Count broken rules of every micro-batch under `out`; with vec also the least and largest length, with key the keys."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(n) for n, c in rules.items()]]
    if vec is not None:
        aggs += [F.min(F.size(vec)).alias("least"), F.max(F.size(vec)).alias("most")]

    def batch(df: DataFrame, number: int) -> None:
        rows = df.persist()
        rows.agg(*aggs).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
        if key is not None:
            rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/keys/batch={number}")
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _counts(spark: SparkSession, out: str, names: list[str], *more: Column) -> DataFrame:
    return spark.read.parquet(f"{out}/counts").agg(*[F.sum(n).alias(n) for n in names], *more)


def watch_probs(stream: DataFrame, out: str, checkpoint: str, k: int = 3, probs: str = "probs", tol: float = 1e-3, key: str = "key",
                available_now: bool = True) -> StreamingQuery:
    return watch(stream, prob_rules(k, probs, tol, "label" in stream.columns), out, checkpoint, key, None, available_now)


def probs_report(spark: SparkSession, out: str) -> DataFrame:
    """The report of validate_probs over all batches so far: a key counts as repeated across batches as well."""
    names = [c for c in spark.read.parquet(f"{out}/counts").columns if c not in ("n_rows", "batch")]
    keys = spark.read.parquet(f"{out}/keys").drop("batch")
    repeated = keys.groupBy(*[c for c in keys.columns if c != "n"]).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") - 1).alias("repeated"))
    row = beside(_counts(spark, out, names), repeated)
    return report(row, {**{n: F.col(n) for n in names}, "key_once": F.col("repeated")})


def watch_vectors(stream: DataFrame, out: str, checkpoint: str, vec: str = "vec", available_now: bool = True) -> StreamingQuery:
    return watch(stream, vector_rules(vec=vec), out, checkpoint, None, vec, available_now)


def vectors_report(spark: SparkSession, out: str, n_expected: int | None = None) -> DataFrame:
    """The report of validate_vectors over all batches so far."""
    row = _counts(spark, out, ["n_rows", "finite"], (F.max("most") - F.min("least")).alias("spread"))
    bad = {"finite": F.col("finite"), "constant_length": F.col("spread")}
    if n_expected is not None:
        bad["row_count"] = F.abs(F.col("n_rows") - n_expected)
    return report(row, bad)
