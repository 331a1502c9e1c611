"""Leakage-safe stratified folds and related samples."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.operators.ordering import hash_order, place_in_shuffle
from foldwright.operators.skew import lookup
from foldwright.session import freeze


def split_fold(folds: DataFrame, k: int, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, validation) for fold k."""
    return folds.where(F.col(fold) != k), folds.where(F.col(fold) == k)


def exclude(df: DataFrame, skip: DataFrame, on: str = "key") -> DataFrame:
    return df.join(skip.select(on), on, "left_anti")


def fold_overlap(folds: DataFrame, key: str = "key", fold: str = "fold") -> DataFrame:
    """Keys that occur in more than one fold: key, n_folds."""
    # One shuffle by key; a set never holds more than the number of folds.
    seen = folds.groupBy(key).agg(F.size(F.collect_set(fold)).cast("bigint").alias("n_folds"))
    return seen.where(F.col("n_folds") > 1)


def stratified_kfold(df: DataFrame, k: int = 5, seed: int = 42, label: str = "label", key: str = "key") -> DataFrame:
    """Add fold: every class is dealt round the folds in seeded order, so counts differ by at most 1."""
    placed = place_in_shuffle(df, label, key, seed)
    return placed.withColumn("fold", (F.col("_before") % k).cast("int")).drop("_before", "_total")


def _dealt(start: Sequence[int], step: int, n: int) -> list[int]:
    """How many of n equal steps each fold gets if every step goes to the fold with the least load (ties: the first fold).

    A step raises a load by `step`, so the n least members of the progressions start + step * j are taken: all below a level, and
    those at the level in fold order until n are reached.
    """
    def below(level: int) -> list[int]:
        return [max(0, -(-(level - s) // step)) for s in start]

    low, high = min(start), max(start) + step * (n + 1)
    while high - low > 1:  # largest level with at most n members below it
        mid = (low + high) // 2
        low, high = (mid, high) if sum(below(mid)) <= n else (low, mid)
    out = below(low)
    for f, s in enumerate(start):
        if sum(out) < n and s + step * out[f] == low:
            out[f] += 1
    return out


def _place_vectors(vectors: Iterable[tuple[str, int, list[int]]], weights: list[int], k: int) -> Iterator[tuple[str, list[int]]]:
    """(vector, end of each fold's share of its groups) for (vector, number of groups, counts), in the order given."""
    filled = [[0] * len(weights) for _ in range(k)]
    for name, n, counts in vectors:
        pull = [w * c for w, c in zip(weights, counts)]
        share = _dealt([sum(p * x for p, x in zip(pull, fold)) for fold in filled], sum(p * c for p, c in zip(pull, counts)), n)
        for fold, m in zip(filled, share):
            for c, x in enumerate(counts):
                fold[c] += m * x
        yield name, list(itertools.accumulate(share))


def stratified_group_kfold(df: DataFrame, k: int = 5, seed: int = 42, n_classes: int = 3, label: str = "label",
                           group: str = "group") -> DataFrame:
    """Add fold so that a group never spans folds and class shares stay even.

    Groups with the same counts per class are interchangeable. One rule holds for all sizes: vectors of counts are taken from the
    largest group's down, and each group goes to the fold that has least of what the group brings (its counts times the fold's,
    each class weighted by its rarity; the first of equal folds). The driver sees each distinct vector once, with its number of
    groups, and deals equal groups in one step. Which of them go where follows their seeded hash order. All in whole numbers, so
    any engine can repeat it. A row without a group is an error.
    """
    missing = F.raise_error(F.lit("a row has no group")).cast(dict(df.dtypes)[group])
    df = df.withColumn(group, F.when(F.col(group).isNull(), missing).otherwise(F.col(group)))
    ns = ["_size", *[f"_n{c}" for c in range(n_classes)]]
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"), *[F.count_if(F.col(label) == c).alias(f"_n{c}") for c in range(n_classes)])
    counts = freeze(counts.withColumn("_v", F.concat_ws(",", *ns)))
    vectors = counts.groupBy("_v", *ns).agg(F.count(F.lit(1)).alias("n")).orderBy(*[F.desc(c) for c in ns])
    totals = counts.agg(*[F.sum(c).alias(c) for c in ns]).first()
    # Size only decides between folds whose classes are equally full.
    weights = [1, *[(totals["_size"] << 20) // totals[c] if totals[c] else 0 for c in ns[1:]]]
    listed = ((r["_v"], r["n"], [r[c] for c in ns]) for r in vectors.toLocalIterator())
    ends = df.sparkSession.createDataFrame(list(_place_vectors(listed, weights, k)), "_v string, _ends array<bigint>")
    placed = lookup(place_in_shuffle(counts.select(group, "_v"), "_v", group, seed), ends, "_v")
    fold = F.size(F.filter("_ends", lambda e: e <= F.col("_before"))).alias("fold")
    return lookup(df, freeze(placed.select(group, fold)), group)


def sample_per_class(df: DataFrame, n: int, seed: int = 42, label: str = "label", key: str = "key") -> DataFrame:
    """n rows of every class in seeded order, for inspection. Each task keeps only its best n per class."""
    w = Window.partitionBy(label).orderBy("_h", key)
    rows = df.withColumn("_h", hash_order(key, seed)).withColumn("_r", F.row_number().over(w))
    return rows.where(F.col("_r") <= n).drop("_h", "_r")


def seeded_sample(df: DataFrame, n: int, seed: int = 42, key: str = "key") -> DataFrame:
    """n rows in seeded order (top-n, no full sort)."""
    return df.withColumn("_h", hash_order(key, seed)).orderBy("_h", key).limit(n).drop("_h")
