"""Tables in the engine's contracts, derived by Spark from whole tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prob_table(spark: SparkSession, sf_dir: str, a: int = 7, b: int = 13, c: int = 29) -> DataFrame:
    """key, label, fold, probs for every order: arithmetic scores that lean towards the label."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    base = o.select(F.col("o_orderkey").alias("key"), label.alias("label"),
                    (F.col("o_orderkey") % 5).cast("int").alias("fold"),
                    F.floor("o_totalprice").cast("bigint").alias("t"))

    def score(mult, mod, lean, i):
        return (1 + (F.col("key") * mult + F.col("t")) % mod
                + F.when(F.col("label") == i, lean).otherwise(0)).cast("double").alias(f"s{i}")

    s = base.select("key", "label", "fold", score(a, 97, 60, 0), score(b, 89, 30, 1), score(c, 83, 90, 2))
    total = F.col("s0") + F.col("s1") + F.col("s2")
    probs = F.array(*[F.col(f"s{i}") / total for i in range(3)]).alias("probs")
    # Stored probabilities would be plain columns. A generator's output is one as well: later
    # filters use the computed value instead of repeating the arithmetic.
    return s.select(F.inline(F.array(F.struct("key", "label", "fold", probs))))


def second_prob_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_table(spark, sf_dir, 11, 17, 23)


def hash_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, hash for every order: orders of one customer fall on three hashes two bits apart."""
    o = table(spark, sf_dir, "orders")
    word = F.col("o_custkey") * F.lit(2654435761).cast("bigint")
    flip = F.expr("shiftleft(1L, cast(o_orderkey % 3 AS int))")
    return o.select(F.col("o_orderkey").alias("key"), word.bitwiseXOR(flip).alias("hash"))


def document_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, hash (md5 of the whole text), source for every document."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), F.md5("text").alias("hash"), "lang", "source", "n_chars", "text")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, label, group for every labelled document; exact copies share the group."""
    docs = document_table(spark, sf_dir).select("key", F.col("hash").alias("group"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    return labels.join(docs, "key")


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, fold, label, vec for every embedding."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("key"), (F.col("vec_id") % 5).cast("int").alias("fold"), "label",
        F.col("embedding").alias("vec"))


def history_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, epoch, train_f1, val_f1: every event is one epoch of its user's run, in time order."""
    e = table(spark, sf_dir, "events")
    val = (F.abs(F.col("value")) / (F.abs(F.col("value")) + 10.0))
    return e.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("epoch"),
        F.when(F.col("event_type") == "error", val / 2).otherwise(val).alias("val_f1"),
        F.least(F.lit(1.0), val + (F.col("event_id") % 17) / 50.0 + 0.3).alias("train_f1"))


def score_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, combo, head, mean, std, min from all line items: one candidate per supplier and return flag."""
    li = table(spark, sf_dir, "lineitem")
    score = (F.col("l_quantity") / 50.0 + F.col("l_discount") + F.col("l_tax")) / 1.2345678
    return li.groupBy(
        F.col("l_linenumber").alias("task"), F.col("l_suppkey").alias("combo"), F.col("l_returnflag").alias("head"),
    ).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"))


def template_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, id for every document, in id order."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"))


def listing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path: a file name for every labelled document, with an extension that depends on its labels."""
    ext = (F.when((F.col("quality") == 1) & (F.col("toxic") == 0), ".jpg")
           .when((F.col("quality") == 1), ".png").when(F.col("toxic") == 1, "").otherwise(".jpeg"))
    labels = table(spark, sf_dir, "labels")
    name = F.concat(F.lit("/corpus/test/doc_"), F.col("doc_id").cast("string"), ext)
    return labels.select(name.alias("path"))
