"""Exact order statistics and quantiles from counts alone.

Every pass counts rows in equal-width buckets of the intervals still in question and then
narrows each interval to the bucket that holds the wanted rank. A pass moves at most
intervals x buckets summary rows (about 200,000); the data are never sorted, shuffled or collected.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Iterable, Mapping

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEAST, _MOST, _SUMMARY_ROWS = 16, 4096, 200_000


def order_statistics(df: DataFrame, value: Column | str, ranks: Mapping[Hashable, Iterable[int]],
                     by: Column | None = None, around: tuple[float, float] = (0.0, 1.0)) -> dict:
    """The value at each 0-based rank (ascending) of each group, as {(group, rank): value}.

    `by` is a column with few distinct values (classes, pairs); `ranks` maps a group to the
    ranks wanted. Without `by` use the group 0. Ranks must be below the group's row count.
    `around` is where most values are expected; it affects the number of passes only.
    """
    value = F.col(value) if isinstance(value, str) else value
    data = df.select((F.lit(0) if by is None else by).alias("g"), value.cast("double").alias("v"))
    return _search(data, lambda sizes: ranks, around, len(ranks))


def _search(data: DataFrame, ranks_for: Callable[[dict], Mapping[Hashable, Iterable[int]]],
            around: tuple[float, float], n_groups: int) -> dict[tuple[Hashable, int], float]:
    """data: g, v. ranks_for gets the group sizes and returns the ranks wanted per group."""
    buckets = max(_LEAST, min(_MOST, _SUMMARY_ROWS // max(n_groups, 1)))
    data = data.where(F.col("v").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)  # two narrow columns
    try:
        first = _count_buckets(data.select("g", _bucket(*map(F.lit, around), buckets).alias("b"), "v"), "g")
        for line in first.values():
            if any(math.isnan(hi) for _, _, _, hi in line):
                raise ValueError("the column holds NaN; validate it first")
        sizes = {g: sum(n for _, n, _, _ in line) for g, line in first.items()}
        found: dict[tuple[Hashable, int], float] = {}
        # interval (group, lo, hi) -> [(rank, rows of the group below the interval)]
        open_: dict[tuple, list[tuple[int, int]]] = {}
        for g, rank in {(g, int(r)) for g, rs in ranks_for(sizes).items() for r in rs}:
            if not 0 <= rank < sizes.get(g, 0):
                raise ValueError(f"group {g!r} has no rank {rank}")
            _settle(g, rank, 0, first[g], found, open_)
        while open_:
            intervals, open_ = open_, {}
            lines = _count_buckets(_inside(data, list(intervals), buckets), "i")
            for i, ((g, _, _), wanted) in enumerate(intervals.items()):
                for rank, below in wanted:
                    _settle(g, rank, below, lines[i], found, open_)
        return found
    finally:
        data.unpersist()


def _bucket(lo: Column, hi: Column, buckets: int) -> Column:
    """Number of v's equal-width bucket; values outside fall into the first or the last one."""
    place = F.floor((F.col("v") - lo) / (hi - lo) * F.lit(float(buckets)))
    return F.least(F.greatest(place, F.lit(0)), F.lit(buckets - 1))


def _inside(data: DataFrame, intervals: list[tuple], buckets: int) -> DataFrame:
    """i, b, v: each row once for every open interval of its group that holds it.

    There are at most as many intervals as ranks asked for.
    """
    kind = dict(data.dtypes)["g"]
    table = data.sparkSession.createDataFrame(
        [(g, i, lo, hi) for i, (g, lo, hi) in enumerate(intervals)], f"g {kind}, i int, lo double, hi double")
    rows = data.join(F.broadcast(table), "g").where(F.col("v").between(F.col("lo"), F.col("hi")))
    return rows.select("i", _bucket(F.col("lo"), F.col("hi"), buckets).alias("b"), "v")


def _count_buckets(rows: DataFrame, by: str) -> dict[Hashable, list[tuple]]:
    """Per group the non-empty buckets in order: (bucket, count, least value, greatest value)."""
    out: dict[Hashable, list[tuple]] = {}
    for r in rows.groupBy(by, "b").agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
        out.setdefault(r[by], []).append((r["b"], r["n"], r["lo"], r["hi"]))
    return {g: sorted(line) for g, line in out.items()}


def _settle(g, rank: int, below: int, line: list[tuple], found: dict, open_: dict) -> None:
    """Find the bucket with the rank; its ends may already be the answer, else it stays open."""
    for _, n, lo, hi in line:
        if rank >= below + n:
            below += n
            continue
        if lo == hi or rank == below:
            found[(g, rank)] = lo
        elif rank == below + n - 1:
            found[(g, rank)] = hi
        else:
            open_.setdefault((g, lo, hi), []).append((rank, below))
        return


def quantiles(df: DataFrame, columns: Mapping[str, Iterable[float]]) -> dict[tuple[str, float], float]:
    """Linearly interpolated quantiles, {(column, q): value}; q between 0 and 1."""
    names = list(columns)
    wanted: dict[tuple[str, float], float | None] = {}

    def ranks_for(sizes):
        out = {}
        for i, c in enumerate(names):
            n = sizes.get(i, 0)
            for q in columns[c]:
                h = wanted[(c, q)] = q * (n - 1) if n else None
                if n:
                    out.setdefault(i, set()).update({math.floor(h), min(math.floor(h) + 1, n - 1)})
        return out

    # All columns share the passes: one (column number, value) row per column.
    cells = [F.struct(F.lit(i).alias("g"), F.col(c).cast("double").alias("v")) for i, c in enumerate(names)]
    at = _search(df.select(F.inline(F.array(*cells))), ranks_for, (0.0, 1.0), len(names))
    last = {i: max((r for g, r in at if g == i), default=0) for i in range(len(names))}
    out = {}
    for (c, q), h in wanted.items():
        i = names.index(c)
        if h is None:
            out[(c, q)] = None
            continue
        low = math.floor(h)
        a, b, t = at[(i, low)], at[(i, min(low + 1, last[i]))], h - low
        out[(c, q)] = a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)
    return out
