"""Vector and probability sets: parquet with an array column, and ingestion of .npy matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.operators.validate import assert_ok, validate_probs, validate_vectors
from foldwright.sources.ranges import read_npy  # noqa: F401
from foldwright.sources.tables import data_path


def read_vectors(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """key, vec as 32-bit floats; non-finite or uneven vectors are an error."""
    rows = spark.read.parquet(data_path(spark, path)).withColumn("vec", F.col("vec").cast("array<float>"))
    if check:
        assert_ok(validate_vectors(rows))
    return rows


def read_probs(spark: SparkSession, path: str, k: int = 3, check: bool = True) -> DataFrame:
    rows = spark.read.parquet(data_path(spark, path)).withColumn("probs", F.col("probs").cast("array<double>"))
    if check:
        assert_ok(validate_probs(rows, k))
    return rows
