"""Duplicate and near-duplicate groups over 64-bit fingerprints.

Near duplicates are found by multi-index hashing (operators/hamming.py), which gives links that connect all hashes within the
threshold, never all pairs. Components follow from the links; star groups lie inside components, which are dealt over tasks in
batches and resolved one after the other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.operators.hamming import MAX_DISTANCE, lowest_near, near_links
from foldwright.operators.ordering import rank_rows
from foldwright.operators.skew import lookup
from foldwright.session import freeze

STAR_GROUP = 4096


def duplicate_groups(df: DataFrame, fingerprint: str = "hash", key: str = "key") -> DataFrame:
    """Fingerprints seen more than once: hash, n, first key. NULL fingerprints are left out."""
    return (
        df.where(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("hash"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key")).where(F.col("n") > 1)
    )


def duplicate_members(df: DataFrame, fingerprint: str = "hash", key: str = "key") -> DataFrame:
    """One row per member of a duplicate group (hash, key): the member lists in long form."""
    groups = duplicate_groups(df, fingerprint, key).select("hash", "n")
    rows = df.where(F.col(fingerprint).isNotNull()).select(F.col(fingerprint).alias("hash"), key)
    return lookup(rows, groups, "hash").where(F.col("n").isNotNull()).drop("n")


def duplicate_summary(df: DataFrame, fingerprint: str = "hash") -> DataFrame:
    """One row: duplicate_groups, duplicate_total, largest, need_group_split."""
    return duplicate_groups(df, fingerprint, fingerprint).agg(
        F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_total"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
    ).withColumn("need_group_split", F.col("duplicate_groups") > 0)


def assign_group_ids(df: DataFrame, fingerprint: str = "hash", key: str = "key") -> DataFrame:
    """Add dense group_id: duplicates share 0..G-1 (largest group first), the others follow by key."""
    groups = rank_rows(duplicate_groups(df, fingerprint, key), [F.desc("n"), F.asc("hash")], name="group_id")
    groups = freeze(groups.select(F.col("hash").alias(fingerprint), "group_id"))
    n_groups = groups.count()
    rows = lookup(df, groups, fingerprint)
    single = rank_rows(rows.where(F.col("group_id").isNull()).drop("group_id"), [F.asc(key)], name="_row")
    single = single.withColumn("group_id", F.col("_row") + n_groups).drop("_row")
    return rows.where(F.col("group_id").isNotNull()).unionByName(single)


def _distinct_hashes(df: DataFrame, fingerprint: str, key: str) -> DataFrame:
    return df.where(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("h")).agg(
        F.min(key).alias("id"))


def _in_key_order(t: int):
    """Task function over rows sorted by component and key: the first free hash of a component takes all free ones within t."""
    def resolve(h: np.ndarray) -> np.ndarray:
        if len(h) == 2:  # neighbours, or they would not be a component
            return np.zeros(2, dtype=np.int64)
        owner, free = np.zeros(len(h), dtype=np.int64), np.ones(len(h), dtype=bool)
        for k in range(len(h)):
            if free[k]:
                mine = np.flatnonzero(free & (np.bitwise_count(h ^ h[k]) <= t))
                owner[mine], free[mine] = k, False
        return owner

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in itertools.chain(batches, [None]):
            if b is not None and not b.num_rows:
                continue
            parts = [x for x in (left, b) if x is not None and x.num_rows]
            if not parts:
                continue
            table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            part = np.array(table.column("_part").to_pylist(), dtype=object)
            at = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            whole = len(at) - (1 if b is None else 2)
            h, owner = table.column("h").to_numpy().view(np.uint64), np.arange(at[whole])
            for lo, hi in zip(at[:whole], at[1:whole + 1]):
                owner[lo:hi] = resolve(h[lo:hi]) + lo
            done = table.slice(0, at[whole])
            yield pa.RecordBatch.from_arrays([done.column("h"), done.column("id").take(pa.array(owner))], ["h", "root"])
            left = table.slice(at[whole])

    return run


def _star(hashes: DataFrame, t: int) -> DataFrame:
    """(h, root): the first unvisited hash in key order takes all unvisited hashes within t.

    Groups never cross components, so tasks resolve components of at most STAR_GROUP hashes one after the other, whatever
    the order of their keys. A larger one takes rounds, in which every hash that is first among its free neighbours takes them.
    """
    linked, alone = _components(hashes, t)
    placed = freeze(linked.withColumnRenamed("root", "_part"))
    large = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > STAR_GROUP).select("_part")
    kind = dict(hashes.dtypes)
    small = placed.join(large, "_part", "left_anti").select("_part", "h", "id").repartition("_part").sortWithinPartitions("_part", "id")
    out = alone.unionByName(small.mapInArrow(_in_key_order(t), f"h {kind['h']}, root {kind['id']}"))
    if not large.isEmpty():
        out = out.unionByName(_star_rounds(freeze(lookup(placed, large.withColumn("_in", F.lit(True)), "_part").where("_in").select("h", "id")), t))
    return out


def _star_rounds(hashes: DataFrame, t: int) -> DataFrame:
    todo = freeze(hashes.join(lowest_near(hashes, hashes, t, "id"), "h"))
    rounds = []
    while not todo.isEmpty():
        # Lowest key of its free neighbourhood: nothing earlier can take this hash any more.
        rounds.append(freeze(todo.where(F.col("low") == F.col("id")).select("h", "id")))
        taken = lowest_near(todo, rounds[-1], t, "id").select("h")
        left = freeze(todo.select("h", "id").join(taken, "h", "left_anti"))
        todo = freeze(left.join(lowest_near(left, left, t, "id"), "h"))
    seeds = reduce(DataFrame.unionByName, rounds)
    # No two seeds are within t, so a seed finds itself.
    return hashes.join(lowest_near(hashes, seeds, t, "id"), "h").select("h", F.col("low").alias("root"))


def _components(hashes: DataFrame, t: int) -> tuple[DataFrame, DataFrame]:
    """(h, id, root) of hashes with a neighbour, rooted at their component's smallest key, and (h, root) of the others."""
    links = near_links(hashes, t)
    both = freeze(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    ends = freeze(both.select(F.col("a").alias("h")).distinct())
    alone = hashes.join(ends, "h", "left_anti").select("h", F.col("id").alias("root"))
    state = freeze(hashes.join(ends, "h").select("h", "id", F.col("id").alias("root")))
    settled = state.isEmpty()
    while not settled:
        seen = lookup(both, state.select(F.col("h").alias("b"), "root"), "b").groupBy(F.col("a").alias("h")).agg(F.min("root").alias("low"))
        step = freeze(state.join(seen, "h").select("h", "id", "root", F.least("root", "low").alias("new")))
        # Follow the root's own new root as well, so long chains halve each round.
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("_next"))
        after = freeze(lookup(step, jump, "new").withColumn("new", F.coalesce("_next", "new")).drop("_next"))
        settled = after.where(F.col("new") != F.col("root")).isEmpty()
        state = after.select("h", "id", F.col("new").alias("root"))
    return state, alone


def near_duplicates(df: DataFrame, threshold: int = 2, mode: str = "star", fingerprint: str = "hash",
                    key: str = "key") -> DataFrame:
    """Add root: the key that names the row's near-duplicate group (its own key when alone).

    star: in key order, a row not yet taken takes every free row within the threshold.
    components: rows connected by steps of at most the threshold (safe against split leakage).
    NULL fingerprints stay alone. A distinct hash is listed in threshold + 1 buckets, in 66 to 70 for thresholds above 3.
    """
    if not 0 <= threshold <= MAX_DISTANCE:
        raise ValueError(f"threshold must lie between 0 and {MAX_DISTANCE}")
    hashes = _distinct_hashes(df, fingerprint, key)
    if threshold == 0:
        roots = hashes.select("h", F.col("id").alias("root"))
    elif mode == "star":
        roots = _star(freeze(hashes), threshold)
    elif mode == "components":
        linked, alone = _components(freeze(hashes), threshold)
        roots = linked.select("h", "root").unionByName(alone)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    out = lookup(df, roots.withColumnRenamed("h", fingerprint), fingerprint)
    return out.withColumn("root", F.coalesce("root", key))


def near_duplicate_groups(df: DataFrame, threshold: int = 2, mode: str = "star", fingerprint: str = "hash",
                          key: str = "key") -> DataFrame:
    """Groups of two or more rows: root, n."""
    return near_duplicates(df, threshold, mode, fingerprint, key).groupBy("root").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
