"""Join helper for a table with a few very frequent keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHARE = 1000


def heavy_keys(rows: DataFrame, on: Sequence[str], least: int = 1000) -> list[tuple]:
    """Keys holding more than one row in a thousand (and `least` rows); at most a thousand exist."""
    known = rows
    for c in on:
        known = known.where(F.col(c).isNotNull())
    counts = known.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        total = counts.agg(F.sum("n")).first()[0] or 0
        return [tuple(r[c] for c in on) for r in counts.where(F.col("n") > max(total / _SHARE, least)).collect()]
    finally:
        counts.unpersist()


def _is_one_of(on: Sequence[str], keys: list[tuple]) -> Column:
    if len(on) == 1:
        return F.coalesce(F.col(on[0]).isin([k[0] for k in keys]), F.lit(False))
    wanted = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(k, on)]) for k in keys])
    return F.coalesce(F.array_contains(wanted, F.struct(*on)), F.lit(False))


def lookup(rows: DataFrame, table: DataFrame, on: str | Sequence[str], least: int = 1000) -> DataFrame:
    """Left join to a table that is unique on `on`, however uneven `rows` is.

    Rows of a heavy key are matched against the at most 1000 table rows of the heavy keys by
    broadcast; all other rows take the ordinary join, where no key is large.
    """
    on = [on] if isinstance(on, str) else list(on)
    heavy = heavy_keys(rows, on, least)
    if not heavy:
        return rows.join(table, on, "left")
    hot = _is_one_of(on, heavy)
    few = F.broadcast(table.where(hot))
    return rows.where(~hot).join(table, on, "left").unionByName(rows.where(hot).join(few, on, "left"))
