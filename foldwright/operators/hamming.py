"""Neighbours within a Hamming distance among 64-bit words: multi-index hashing in bounded buckets.

The 64 bits are cut into bands. Two words within distance t differ by at most r = floor(t / bands) bits in one of them, so they
meet in a bucket: for t up to 3 there are t + 1 bands and r = 0; above, bands of about 64 / (t / 3 + 1) bits with r = 2, and a
word is listed under its band and under every band value one bit away (r / 2 from either side). That makes 2 to 4 entries per
word, 66 to 70 above t = 3, for any t. Buckets are verified by the whole distance where they lie.

A bucket above BUCKET entries, such as the words of nearly blank pictures, is listed anew by bands of the other bits, where its
words must meet again; what is still too large is cut into blocks, and every pair of blocks is a bucket. No pair is ever left
out. A task never emits the pairs of a large bucket: it emits a spanning forest, or the least value that every word sees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.operators.skew import lookup
from foldwright.session import freeze

MAX_DISTANCE = 16
BUCKET = 4096
_SMALL = 16
_KEY = ["_b", "_w", "_b2", "_w2", "_i", "_j"]


def bands(t: int, bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the bands for distance t."""
    n = t + 1 if t <= 3 else t // 3 + 1
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _listed(h: Column, t: int, bits: int) -> Column:
    """Entries (band, value) of a word's low `bits` bits."""
    out = []
    for b, (first, width) in enumerate(bands(t, bits)):
        word = F.shiftrightunsigned(h, first).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        flips = [0] if t <= 3 else [0, *(1 << i for i in range(width))]
        out += [F.struct(F.lit(b).alias("b"), word.bitwiseXOR(F.lit(f)).alias("w")) for f in flips]
    return F.array(*out)


def _turned(t: int) -> Column:
    """The word turned so that the bits outside its band `_b` are the lowest."""
    out = F.col("h")
    for b, (first, width) in enumerate(bands(t, 64)):
        end = first + width
        turned = F.shiftrightunsigned("h", end).bitwiseOR(F.shiftleft("h", 64 - end)) if end < 64 else F.col("h")
        out = F.when(F.col("_b") == b, turned).otherwise(out)
    return out


def _with(rows: DataFrame, **columns) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c not in columns], *[v.alias(k) for k, v in columns.items()])


def _too_large(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets within the bound, and the others with _n, their bucket's size. rows is frozen."""
    large = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BUCKET)
    marked = lookup(rows, large, key)
    return marked.where(F.col("_n").isNull()).drop("_n"), marked.where(F.col("_n").isNotNull())


def _buckets(rows: DataFrame, t: int) -> DataFrame:
    """rows (h and more) once per bucket they belong to, in partitions that hold buckets whole and in order."""
    none = F.lit(0)
    entry = F.explode(_listed(F.col("h"), t, 64)).alias("_e")
    listed = rows.select("*", entry).select("*", F.col("_e.b").alias("_b"), F.col("_e.w").alias("_w")).drop("_e")
    sizes = listed.groupBy("_b", "_w").agg(F.count(F.lit(1)).alias("_n"))
    if sizes.where(F.col("_n") > BUCKET).isEmpty():
        out = _with(listed, _b2=none, _w2=none.cast("bigint"), _i=none, _j=none)
    else:
        out = _split(freeze(listed), t)
    return out.repartition(*[F.col(c) for c in _KEY]).sortWithinPartitions(*_KEY)


def _split(listed: DataFrame, t: int) -> DataFrame:
    none = F.lit(0)
    fits, large = _too_large(listed, ["_b", "_w"])
    narrow = min(64 - width for _, width in bands(t, 64))
    again = _with(large.drop("_n"), _t=_turned(t)).select("*", F.explode(_listed(F.col("_t"), t, narrow)).alias("_e"))
    # Bits beyond `narrow` belong to no band; bands of fewer bits find the same pairs.
    again = freeze(again.select("*", F.col("_e.b").alias("_b2"), F.col("_e.w").alias("_w2")).drop("_e", "_t"))
    fits2, large2 = _too_large(again, ["_b", "_w", "_b2", "_w2"])
    n = F.ceil(F.col("_n") / F.lit(BUCKET / 2)).cast("int")
    own = F.pmod(F.xxhash64("h"), n).cast("int")
    blocks = _with(large2, _own=own, _x=F.explode(F.sequence(F.lit(0), n - 1)))
    blocks = _with(blocks, _i=F.least("_own", "_x"), _j=F.greatest("_own", "_x")).drop("_own", "_x", "_n")
    parts = [_with(fits, _b2=none, _w2=none.cast("bigint"), _i=none, _j=none), _with(fits2, _i=none, _j=none), blocks]
    # Values of _b2 above 0 keep second lists apart from first ones.
    parts[1:] = [_with(p, _b2=F.col("_b2") + 1) for p in parts[1:]]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _runs(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """work(table, begin and end of every bucket of two rows or more) of whole buckets, in order."""
    left: pa.Table | None = None

    def cut(table: pa.Table, last: bool):
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for c in _KEY:
            v = table.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        at = np.append(np.flatnonzero(new), table.num_rows)
        whole = len(at) - 1 if last else len(at) - 2
        begin, end = at[:whole], at[1:whole + 1]
        keep = end - begin > 1
        return begin[keep], end[keep], table.slice(at[whole])

    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        table = table if left is None else pa.concat_tables([left, table]).combine_chunks()
        begin, end, left = cut(table, False)
        if len(begin):
            yield from work(table, begin, end)
    if left is not None and left.num_rows > 1:
        begin, end, _ = cut(left, True)
        if len(begin):
            yield from work(left, begin, end)


def _near_pairs(h: np.ndarray, begin: np.ndarray, end: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within t inside small buckets."""
    first, second = [], []
    for shift in range(1, int((end - begin).max(initial=1))):
        b, e = begin[end - begin > shift], end[end - begin > shift]
        n = e - b - shift
        i = np.repeat(b - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        i = i[np.bitwise_count(h[i] ^ h[i + shift]) <= t]
        first.append(i)
        second.append(i + shift)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


def _forest(h: np.ndarray, t: int) -> np.ndarray:
    """For every word the place of its group's first word; groups are joined by steps within t."""
    root, open_ = np.full(len(h), -1), np.arange(len(h))
    while len(open_):
        root[open_[0]], front = open_[0], open_[:1]
        seed, open_ = open_[0], open_[1:]
        while len(front) and len(open_):
            hit = np.zeros(len(open_), dtype=bool)
            for lo in range(0, len(front), 256):
                hit |= (np.bitwise_count(h[front[lo:lo + 256], None] ^ h[None, open_]) <= t).any(axis=0)
            front, open_ = open_[hit], open_[~hit]
            root[front] = seed
    return root


def near_links(hashes: DataFrame, t: int) -> DataFrame:
    """(a, b): distinct links, each inside one group, that connect all words h within t of each other."""
    def work(table: pa.Table, begin: np.ndarray, end: np.ndarray):
        h = table.column("h").to_numpy().view(np.uint64)
        small = end - begin <= _SMALL
        i, j = _near_pairs(h, begin[small], end[small], t)
        a, b = [i], [j]
        for lo, hi in zip(begin[~small], end[~small]):
            root = _forest(h[lo:hi], t) + lo
            other = np.flatnonzero(root != np.arange(lo, hi)) + lo
            a.append(root[other - lo])
            b.append(other)
        i, j = np.concatenate(a), np.concatenate(b)
        x, y = h[i].view(np.int64), h[j].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    rows = _buckets(hashes.select("h"), t).select("h", *_KEY)
    return rows.mapInArrow(lambda batches: _runs(batches, work), "a bigint, b bigint").distinct()


def lowest_near(points: DataFrame, sources: DataFrame, t: int, value: str) -> DataFrame:
    """(h, low): for each word of `points` the least value among the words of `sources` within t; none without one."""
    kind = dict(sources.dtypes)[value]
    rows = points.select("h", F.lit(None).cast(kind).alias("_v"), F.lit(True).alias("_ask")).unionByName(
        sources.select("h", F.col(value).alias("_v"), F.lit(False).alias("_ask")))

    def work(table: pa.Table, begin: np.ndarray, end: np.ndarray):
        h, ask = table.column("h").to_numpy().view(np.uint64), table.column("_ask").to_numpy(zero_copy_only=False)
        values = np.array(table.column("_v").to_pylist(), dtype=object)
        words, lows = [], []
        for lo, hi in zip(begin, end):
            of, give = np.flatnonzero(ask[lo:hi]) + lo, np.flatnonzero(~ask[lo:hi]) + lo
            if not len(of) or not len(give):
                continue
            give = give[np.argsort(values[give], kind="stable")]
            for s in range(0, len(of), 256):
                hit = np.bitwise_count(h[of[s:s + 256], None] ^ h[None, give]) <= t
                got = hit.any(axis=1)
                words.append(h[of[s:s + 256][got]])
                lows.append(values[give[hit.argmax(axis=1)[got]]])
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(words).view(np.int64)), pa.array(np.concatenate(lows).tolist(), table.schema.field("_v").type)],
                                             ["h", "low"])

    found = _buckets(rows, t).select("h", "_v", "_ask", *_KEY).mapInArrow(lambda batches: _runs(batches, work), f"h bigint, low {kind}")
    return found.groupBy("h").agg(F.min("low").alias("low"))
