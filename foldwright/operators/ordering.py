"""Global order without a single-task window.

`ordered_chunks` range-partitions rows by a total order and freezes each row's chunk and
position. Ranks, running values and neighbours are then computed inside chunks, and the short
table of per-chunk summaries carries the state across chunk borders. A group holding a third
of all rows is simply spread over a third of the chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.session import freeze, shuffle_width

_POSITION_BITS = 33


def ordered_chunks(df: DataFrame, order: Sequence[Column], group: Sequence[str] = (),
                   chunks: int | None = None) -> DataFrame:
    """Add _chunk and _pos. `order` must end in a unique column, so that ties cannot pile up."""
    keys = [F.col(g) for g in group] + list(order)
    laid_out = df.repartitionByRange(chunks or shuffle_width(df.sparkSession), *keys)
    numbered = laid_out.sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    # The range bounds come from a sample: freeze rows with their chunk so both stay together.
    return freeze(numbered).select(
        "*",
        F.shiftright("_id", _POSITION_BITS).cast("int").alias("_chunk"),
        F.col("_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_pos"),
    ).drop("_id")


def _before(group: Sequence[str]):
    # Chunk summaries only: at most one row per chunk for each group.
    return Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def _attach(rows: DataFrame, summary: DataFrame, on: list[str], few_groups: bool) -> DataFrame:
    # With no group, or class-sized groups, the summary has at most chunks x groups rows.
    return rows.join(F.broadcast(summary) if few_groups else summary, on)


def number_rows(rows: DataFrame, group: Sequence[str] = (), name: str = "rank",
                few_groups: bool = True) -> DataFrame:
    """0-based row number inside each group, for chunked rows."""
    on = [*group, "_chunk"]
    summary = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    summary = summary.select(
        *on, (F.coalesce(F.sum("_n").over(_before(group)), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    out = _attach(rows, summary, on, few_groups or not group)
    return out.withColumn(name, F.col("_pos") + F.col("_shift")).drop("_shift")


def rank_rows(df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), name: str = "rank",
              few_groups: bool = True, chunks: int | None = None) -> DataFrame:
    """0-based row number in `order`, inside each group.

    few_groups says that the number of groups is bounded by the number of classes or pairs;
    pass False when groups grow with the data.
    """
    rows = ordered_chunks(df, order, group, chunks)
    return number_rows(rows, group, name, few_groups).drop("_chunk", "_pos")


def running_max(rows: DataFrame, order: Sequence[Column], group: Sequence[str], value: Column,
                name: str, few_groups: bool = False) -> DataFrame:
    """Largest value on earlier rows of the group (NULL on the first), for chunked rows."""
    on = [*group, "_chunk"]
    inside = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summary = rows.groupBy(*on).agg(F.max(value).alias("_top"))
    summary = summary.select(*on, F.max("_top").over(_before(group)).alias("_carry"))
    out = _attach(rows.withColumn(name, F.max(value).over(inside)), summary, on, few_groups)
    return out.withColumn(name, F.greatest(F.col(name), F.col("_carry"))).drop("_carry")


def hash_order(key: str | Column, seed: int) -> Column:
    """A seeded order that any engine can reproduce."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def shuffled_offsets(df: DataFrame, group: str, weight: Column, digits: int) -> DataFrame:
    """Per (group, hash prefix): weight that comes earlier in hash order, and the group total.

    At most classes x 16**digits rows, whatever the size of df.
    """
    cell = df.groupBy(group, F.substring("_h", 1, digits).alias("_slot")).agg(F.sum(weight).alias("_w"))
    ahead = Window.partitionBy(group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return cell.select(
        group, "_slot",
        F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_ahead"),
        F.sum("_w").over(Window.partitionBy(group)).alias("_total"),
    )


def place_in_shuffle(df: DataFrame, group: str, key: str, seed: int, weight: Column | None = None,
                     slice_rows: int = 50_000) -> DataFrame:
    """Add _before (weight ahead of the row in the group's seeded order) and _total.

    The order is by hash, so cutting each group by hash prefix gives even slices. The prefix is as long as it takes for
    a window to hold about slice_rows rows; the result does not depend on it.
    """
    weight = F.lit(1) if weight is None else weight
    digits, n = 1, df.count()
    while slice_rows * 16 ** digits < n and digits < 12:
        digits += 1
    rows = df.withColumn("_h", hash_order(key, seed)).withColumn("_slot", F.substring("_h", 1, digits))
    offsets = shuffled_offsets(rows, group, weight, digits)
    ahead = (Window.partitionBy(group, "_slot").orderBy("_h", key)
             .rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("_in", F.coalesce(F.sum(weight).over(ahead), F.lit(0)))
    out = out.join(offsets, [group, "_slot"])
    return out.withColumn("_before", F.col("_in") + F.col("_ahead")).drop("_h", "_slot", "_in", "_ahead")
