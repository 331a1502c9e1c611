"""Put one-row tables side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(row: DataFrame, *others: DataFrame) -> DataFrame:
    """Append the columns of other one-row tables, as scalar subqueries."""
    for i, other in enumerate(others):
        name = f"_row{i}"
        row = row.withColumn(name, other.select(F.struct("*").alias(name)).scalar())
        row = row.select("*", f"{name}.*").drop(name)
    return row
