"""Corpus profile: class shares, weights, sizes, histograms, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.probs import class_name
from foldwright.operators.metrics import classes
from foldwright.operators.order_stats import quantiles
from foldwright.operators.single import beside
from foldwright.schema import CLASS_NAMES


def class_distribution(df: DataFrame, k: int = 3, names: Sequence[str] = CLASS_NAMES,
                       label: str = "label") -> DataFrame:
    """label, label_name, n, share; every class appears. Labels outside 0..k-1 belong to none; validate_probs reports them."""
    counts = df.where(F.col(label).between(0, k - 1)).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    rows = classes(df.sparkSession, k).join(F.broadcast(counts), "label", "left")
    rows = rows.select("label", class_name("label", names).alias("label_name"),
                       F.coalesce("n", F.lit(0)).alias("n"))
    # K rows after the aggregation.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return rows.withColumn("share", F.try_divide(F.col("n"), total))


def class_weights(df: DataFrame, k: int = 3, label: str = "label") -> DataFrame:
    """label, n, weight = N / (K * n); infinite for a class without rows."""
    rows = class_distribution(df, k, [str(i) for i in range(k)], label)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return rows.select(
        "label", "n",
        F.when(F.col("n") == 0, F.lit(float("inf")))
        .otherwise(total / (F.lit(k) * F.when(F.col("n") == 0, 1).otherwise(F.col("n")))).alias("weight"),
    )


def prediction_mix(df: DataFrame, k: int = 3, floor: float = 0.01, pred: str = "predicted") -> DataFrame:
    """Share of each predicted class, with a flag for a suspiciously rare one."""
    return class_distribution(df, k, [str(i) for i in range(k)], pred).select(
        F.col("label").alias("predicted"), "n", "share",
        (F.coalesce("share", F.lit(0.0)) < floor).alias("too_rare"),
    )


def size_summary(df: DataFrame, width: str = "width", height: str = "height",
                 channels: str = "channels") -> DataFrame:
    """One row: min, max and whole-number median of both sizes and the sorted channel set."""
    medians = quantiles(df, {width: [0.5], height: [0.5]})

    def median(c):
        m = medians[(c, 0.5)]
        return F.lit(None if m is None else int(m)).cast("bigint")

    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(width).alias("width_min"), F.max(width).alias("width_max"),
        F.min(height).alias("height_min"), F.max(height).alias("height_max"),
        # Channel counts (1, 3, 4 ...) or another column with few distinct values.
        F.concat_ws(",", F.sort_array(F.collect_set(F.col(channels).cast("string")))).alias("channels"),
    ).withColumns({"width_median": median(width), "height_median": median(height)})


def histogram(df: DataFrame, value: str, bins: int, by: str | None = None) -> DataFrame:
    """Counts and density per equal-width bin over each group's own range; the last bin is closed.

    Groups (`by`) are classes or another column with few values.
    """
    group = [by] if by else []
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull())
    ends = rows.groupBy(*group).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(F.lit(1)).alias("total"))
    if by:
        rows = rows.join(ends, by)
    else:
        e = ends.first()
        rows = rows.select("*", F.lit(e["lo"]).alias("lo"), F.lit(e["hi"]).alias("hi"),
                           F.lit(e["total"]).alias("total"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.floor((v - F.col("lo")) / F.when(width == 0, F.lit(1.0)).otherwise(width))
    counts = rows.groupBy(
        *group, F.least(place, F.lit(bins - 1)).cast("int").alias("bin"), "lo", "hi", "total"
    ).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        *group, "bin", (F.col("lo") + F.col("bin") * width).alias("left_edge"), "n",
        F.try_divide(F.col("n"), F.col("total") * width).alias("density"),
    )


def drop_cap(n: int, total: int, pct: float) -> bool:
    """n stays within pct percent of total, rounded down."""
    return n <= int(total * pct / 100)


def table_digest(df: DataFrame) -> DataFrame:
    """Row-order-free digest of a table: row count, sum of row hashes, digest of the schema."""
    cols = sorted(df.columns)
    fields = dict(df.dtypes)
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols])
    part = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(part).cast("string").alias("content_sum")).withColumn(
        "schema_digest", F.substring(F.sha2(F.lit(",".join(f"{c}:{fields[c]}" for c in cols)), 256), 1, 16)
    )


def eda_stats(distribution: DataFrame, sizes: DataFrame, duplicates: DataFrame, n_corrupt: int = 0) -> DataFrame:
    """One nested row that gathers the profile; each input is a table of at most K rows."""
    counts = distribution.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label_name", "n")))).alias("class_counts"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label_name", "share")))).alias("class_ratios"),
    )
    return beside(counts, sizes.select(F.struct("*").alias("sizes")),
                  duplicates.select("duplicate_groups", "duplicate_total", "need_group_split"),
                  ).withColumn("n_corrupt", F.lit(n_corrupt))
