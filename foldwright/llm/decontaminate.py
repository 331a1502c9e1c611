"""Benchmark decontamination by latent semantic retrieval, then longest-common-subsequence and answer checks.

1. Document frequencies of words over all documents, in a table of hashed cells of fixed size, give the TF-IDF weights.
2. The benchmark's texts are cut into overlapping passages, and the passages of a part are factorised together by a randomised
   SVD: from a random start, scans over the passage rows give A'(A B), summed by word; the driver makes the columns of B
   orthonormal, and after POWERS scans turns them into the leading singular vectors. There are at most RANK of them and at most
   half as many as passages, so passages share directions: words that stand together in the benchmark lie close.
3. Every passage of every document is projected and compared with the items' passages by the cosine inside the latent space.
   Words the benchmark lacks fall away there, so a passage with changed words stays near its original. Candidates must share
   SHARED of the item passage's words.
4. A short item is a small part of a document's passage, so items of up to SMALL words are also looked up by their rarest words,
   one of which every copy must hold, and by their answers' rarest word; those under SHORT words by one word of theirs.
5. The words around a hit are compared with the whole item: the longest common subsequence must cover most of it, or, for
   a paraphrase, much of it and the answer (the item's last words) word for word.

The benchmark is read in parts of at most PART_CHARS characters; what a part broadcasts is bounded by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import store, text_slices
from foldwright.llm.shingles import words

STEP = 16  # a passage is two steps of words, and passages are one step apart
COSINE = 0.5  # inside the latent space
WEIGHT = 0.16  # share of a document passage's squared weights on words of the benchmark, at least
SHARED = 0.35
COPY, PARAPHRASE = 0.8, 0.6
SMALL = 2 * STEP  # items of up to so many words are looked up by single words as well
SHORT = 8  # items of fewer words must stand word for word
RANK, POWERS, SPARE = 128, 3, 8
PART_CHARS = 1_000_000
CELL_BITS = 18
_SEGMENT = 4096


def _cells(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << CELL_BITS, dtype=np.int64)
    for batch in batches:
        for _, texts in text_slices(batch, 0):
            word, begin = words(texts)
            cell = _cells(word)
            distinct = [np.unique(cell[x:y]) for x, y in zip(begin[:-1], begin[1:])]
            counts += np.bincount(np.concatenate(distinct), minlength=len(counts))
    for segment, part in enumerate(counts.reshape(-1, _SEGMENT)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([part.tobytes()], pa.binary())],
                                             names=["segment", "counts"])


def _sum_cells(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, dtype=np.int64) for c in group["counts"])
    return pd.DataFrame({"segment": group["segment"].iloc[:1], "counts": [total.tobytes()]})


def word_weights(texts: DataFrame) -> np.ndarray:
    """ln(1 + N / documents with a word of the cell), over all rows of the column text (no nulls)."""
    schema = "segment bigint, counts binary"
    parts = texts.select("text").mapInArrow(_count_words, schema).withColumn("salt", F.spark_partition_id() % 64)
    some = parts.groupBy("segment", "salt").applyInPandas(_sum_cells, schema)
    out = np.zeros(1 << CELL_BITS, dtype=np.int64)
    for r in some.groupBy("segment").applyInPandas(_sum_cells, schema).collect():
        out[r["segment"] * _SEGMENT:(r["segment"] + 1) * _SEGMENT] = np.frombuffer(r["counts"], dtype=np.int64)
    return np.log1p(texts.count() / np.maximum(out, 1)).astype(np.float32)


# --- the index -----------------------------------------------------------------------------------------

def _passages(word: np.ndarray) -> list[np.ndarray]:
    return [word[s:s + 2 * STEP] for s in range(0, max(1, len(word) - STEP), STEP)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, text -> the item's words, as the row of passage -1, and its passages."""
    for batch in batches:
        for rows, texts in text_slices(batch, 1):
            word, begin = words(texts)
            item, nth, held = [], [], []
            for k, (b, e) in enumerate(zip(begin[:-1], begin[1:])):
                for n, part in enumerate([word[b:e], *_passages(word[b:e])], -1):
                    item.append(k)
                    nth.append(n)
                    held.append(part.tobytes())
            at = pa.array(item, pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), pa.array(nth, pa.int64()), pa.array(held, pa.binary())],
                                             names=["item_id", "text", "nth", "words"])


def _padded(parts: list[bytes], vocabulary: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the vocabulary, TF-IDF weights of unit length) of passages, filled up with place -1 and weight 0."""
    place, weight = np.full((len(parts), 2 * STEP), -1), np.zeros((len(parts), 2 * STEP), dtype=np.float32)
    for row, part in enumerate(parts):
        word = np.frombuffer(part, np.uint64)
        place[row, :len(word)] = np.searchsorted(vocabulary, word)
        weight[row, :len(word)] = idf[_cells(word)]
    # A word that stands n times in a passage has n times its weight: its places add up in every product.
    same = (place[:, :, None] == place[:, None, :]) & (place[:, :, None] >= 0)
    norm = np.sqrt((weight * np.einsum("pij,pj->pi", same.astype(np.float32), weight)).sum(axis=1, keepdims=True))
    return place, weight / np.maximum(norm, 1e-9)


def _project(place: np.ndarray, weight: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows times b, whose last row stands for place -1."""
    out = np.empty((len(place), b.shape[1]), dtype=np.float32)
    for lo in range(0, len(place), 512):
        out[lo:lo + 512] = np.matmul(weight[lo:lo + 512, None, :], b[place[lo:lo + 512]])[:, 0, :]
    return out


def _partial(sent, vocabulary, idf):
    """Task function: the part of A'(A B) that this task's passages give, word by word, in pieces of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        total = np.zeros((len(b), b.shape[1]), dtype=np.float64)
        for batch in batches:
            place, weight = _padded(batch.column(0).to_pylist(), vocabulary.value, idf.value)
            y = _project(place, weight, b)
            for lo in range(0, len(place), 512):
                np.add.at(total, place[lo:lo + 512], weight[lo:lo + 512, :, None] * y[lo:lo + 512, None, :])
        for piece in range(0, len(b) - 1, _SEGMENT):
            part = total[piece:min(piece + _SEGMENT, len(b) - 1)]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([part.tobytes()], pa.binary())], names=["segment", "counts"])

    return run


def _sum_pieces(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c) for c in group["counts"])
    return pd.DataFrame({"segment": group["segment"].iloc[:1], "counts": [total.tobytes()]})


def factorise(passages: DataFrame, n: int, vocabulary, idf, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """(words of the vocabulary, directions): the leading right singular vectors of the n passages (column words).

    vocabulary and idf are broadcast variables. At most half as many directions as passages.
    """
    spark, size = passages.sparkSession, len(vocabulary.value)
    rank = max(1, min(rank, n // 2, size))
    wide = min(rank + SPARE, n, size)
    b = np.random.default_rng(seed).standard_normal((size, wide))
    for _ in range(POWERS):
        b, _ = np.linalg.qr(b)
        sent = spark.sparkContext.broadcast(np.vstack([b, np.zeros((1, wide))]).astype(np.float32))
        parts = passages.select("words").mapInArrow(_partial(sent, vocabulary, idf), "segment bigint, counts binary")
        after = np.zeros_like(b)
        for r in parts.groupBy("segment").applyInPandas(_sum_pieces, "segment bigint, counts binary").collect():  # vocabulary x width
            piece = np.frombuffer(r["counts"]).reshape(-1, wide)
            after[r["segment"]:r["segment"] + len(piece)] = piece
        # b is orthonormal and b'A'Ab small: its eigenvectors, largest first, turn b into the singular vectors.
        small, turn = np.linalg.eigh(b.T @ after)
        b, after = b @ turn[:, ::-1], after @ turn[:, ::-1]
        b, leading = after, b
    return leading[:, :rank].astype(np.float32)


def _keys(k: int, word: np.ndarray, idf: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(word, k, run, size, at) for an item of up to SMALL words: where it can stand, one of these words does, and item[run:run +
    size] word for word around it, the word being its at-th.

    A copy lacks at most a part 1 - COPY of the item's words, so it holds one of any few more of them: the rarest are taken.
    A paraphrase holds the answer, and items under SHORT words stand as they are.
    """
    n = len(word)
    if not 0 < n <= SMALL:
        return []
    rarity = idf[_cells(word)]

    def run(first: int, size: int) -> tuple[int, int, int, int, int]:
        at = int(np.argmax(rarity[first:first + size]))
        return int(word[first + at]), k, first, size, at

    if n < SHORT:
        return [run(0, n)]
    lacking = next(m for m in range(n, -1, -1) if (n - m) / n >= COPY)
    rarest = np.argsort(-rarity, kind="stable")[:lacking + 1]
    answer = max(3, n // 5)
    return [(w, k, 0, 1, 0) for w in {int(word[i]) for i in rarest}] + [run(n - answer, answer)]


class _Space:
    """The items of a part in their latent space, ready to be asked."""

    def __init__(self, items: list[int], item_words: list[np.ndarray], v: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray):
        self.items, self.vocabulary = np.array(items, dtype=np.int64), vocabulary
        self.item_words = [w.tolist() for w in item_words]
        self.v = np.vstack([v, np.zeros((1, v.shape[1]), dtype=np.float32)])
        cut = [(k, p) for k, w in enumerate(item_words) for p in _passages(w)]
        self.owner = np.array([k for k, _ in cut], dtype=np.int64)
        self.place, weight = _padded([p.tobytes() for _, p in cut], vocabulary, idf)
        self.latent = _unit(_project(self.place, weight, self.v))
        self.size = (self.place >= 0).sum(axis=1)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        keys = [x for k, w in enumerate(item_words) for x in _keys(k, w, idf)]
        self.key_place, self.key_item, self.key_run, self.key_size, self.key_at = np.array(
            [(int(np.searchsorted(self.vocabulary, w)), *x) for w, *x in keys], dtype=np.int64).reshape(-1, 5).T
        order = np.argsort(self.key_place, kind="stable")
        for c in ("place", "item", "run", "size", "at"):
            setattr(self, f"key_{c}", getattr(self, f"key_{c}")[order])

    def places(self, word: np.ndarray) -> np.ndarray:
        """Column of every word, -1 outside the vocabulary."""
        out = np.full(len(word), -1, dtype=np.int64)
        at = np.flatnonzero(self.maybe[(word >> np.uint64(44)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.vocabulary, word[at]), len(self.vocabulary) - 1)
        out[at] = np.where(self.vocabulary[found] == word[at], found, -1)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def lcs_length(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, one bit per word of the item."""
    bit: dict[int, int] = {}
    for k, w in enumerate(item):
        bit[w] = bit.get(w, 0) | (1 << k)
    full = (1 << len(item)) - 1
    v = full
    for w in text:
        m = bit.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _holds(text: list[int], part: list[int]) -> bool:
    """part stands word for word in text."""
    first, n = part[0], len(part)
    return any(text[k] == first and text[k:k + n] == part for k in range(len(text) - n + 1))


def judge(item: list[int], text: list[int]) -> tuple[float, str | None]:
    """(share of the item's words in the longest common subsequence, kind). kind: copy, paraphrase or None."""
    if not item or not text:
        return 0.0, None
    if len(item) < SHORT:
        held = _holds(text, item)
        return float(held), "copy" if held else None
    share = lcs_length(item, text) / len(item)
    if share >= COPY:
        return share, "copy"
    answer = item[-max(3, len(item) // 5):]
    return share, "paraphrase" if share >= PARAPHRASE and _holds(text, answer) else None


def _searched(sent_parts, sent_idf, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = sent_idf.value
        space = _Space(*sent_parts.value, idf)
        for batch in batches:
            out = []
            for rows, texts in text_slices(batch, 1):
                word, begin = words(texts)
                if len(word):
                    ids = rows.column(0).to_pylist()
                    out += _search_space(space, idf, cosine, word, begin, ids)
                    out += _search_keys(space, word, begin, ids)
            if out:
                doc, item, share, kind, first = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(share, pa.float64()), pa.array(kind),
                     pa.array(first, pa.int64())], names=["doc_id", "item_id", "overlap", "kind", "first_word"])

    return run


def _search_space(space: _Space, idf, cosine, word, begin, ids):
    place, weight = space.places(word), idf[_cells(word)]
    size = np.diff(begin)
    steps = -(-size // STEP)
    at = np.concatenate([np.arange(b, b + n, STEP) for b, n in zip(begin[:-1].tolist(), size.tolist())])
    owner = np.repeat(np.arange(len(size)), steps)
    squares = weight * weight
    whole = np.add.reduceat(squares, at)
    inside = np.add.reduceat(np.where(place >= 0, squares, 0), at)
    # A passage is a step and the next one of its text; the last step alone only where it is the only one.
    more = np.append(owner[1:] == owner[:-1], False)
    whole = whole + np.where(more, np.append(whole[1:], 0), 0)
    inside = inside + np.where(more, np.append(inside[1:], 0), 0)
    chosen = np.flatnonzero((more | (steps[owner] == 1)) & (inside >= WEIGHT * whole) & (inside > 0))
    if not len(chosen):
        return []
    hits: dict[tuple[int, int], list[int]] = {}
    for c in range(0, len(chosen), 512):
        part = chosen[c:c + 512]
        low, high = at[part], np.minimum(at[part] + 2 * STEP, begin[owner[part] + 1])
        cell = low[:, None] + np.arange(2 * STEP)
        # Words outside the vocabulary fall on the row of zeros at the end.
        column = np.where(cell < high[:, None], place[np.minimum(cell, len(word) - 1)], -1)
        latent = _unit(_project(column, weight[np.minimum(cell, len(word) - 1)], space.v))
        p, q = np.nonzero(latent @ space.latent.T >= cosine)
        for lo in range(0, len(p), 4096):
            x, y = p[lo:lo + 4096], q[lo:lo + 4096]
            there = (space.place[y][:, :, None] == column[x][:, None, :]).any(axis=2) & (space.place[y] >= 0)
            for k in np.flatnonzero(there.sum(axis=1) >= SHARED * space.size[y]):
                hits.setdefault((int(owner[part[x[k]]]), int(space.owner[y[k]])), []).append(int(low[x[k]]))
    out = []
    present: tuple[int, np.ndarray] | None = None
    for (d, k), places in sorted(hits.items()):
        item, b, e = space.item_words[k], int(begin[d]), int(begin[d + 1])
        if present is None or present[0] != d:
            present = (d, set(word[b:e].tolist()))
        if sum(w in present[1] for w in item) < PARAPHRASE * len(item):
            continue  # no subsequence can be longer than this
        # The words around neighbouring hits, as far as the item may reach.
        best, regions = (0.0, None, 0), []
        for p in sorted(set(places)):
            low, high = max(b, p - len(item)), min(e, p + 2 * STEP + len(item))
            if regions and low <= regions[-1][1] and high - regions[-1][0] <= 4 * (len(item) + 2 * STEP):
                regions[-1][1] = high
            else:
                regions.append([low, high])
        for low, high in regions:
            share, kind = judge(item, word[low:high].tolist())
            if kind and share > best[0]:
                best = (share, kind, low - b)
        if best[1]:
            out.append((ids[d], int(space.items[k]), *best))
    return out


def _search_keys(block: _Block, word, begin, ids):
    """The small items around their keys: every window of twice the item's words, a quarter of them apart, with a key in it."""
    if not len(block.key_place):
        return []
    place = block.places(word)
    at = np.flatnonzero(place >= 0)
    low, high = (np.searchsorted(block.key_place, place[at], side) for side in ("left", "right"))
    times = high - low
    at = np.repeat(at, times)
    key = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    doc = np.searchsorted(begin, at, side="right") - 1
    out = []
    for k in np.unique(block.key_item[key]):
        item, mine = np.array(block.item_words[k], dtype=np.uint64), np.flatnonzero(block.key_item[key] == k)
        n, best = len(item), {}
        for c in range(0, len(mine), 4096):
            p, x, d = at[mine[c:c + 4096]], key[mine[c:c + 4096]], doc[mine[c:c + 4096]]
            first, last = begin[d], begin[d + 1]
            # The run word for word, or as many of the item's words around the key as any kind needs.
            run, size = p - block.key_at[x], block.key_size[x]
            held = (run >= first) & (run + size <= last)
            for i in range(n):
                spot, own = np.clip(run + i, 0, len(word) - 1), np.minimum(block.key_run[x] + i, n - 1)
                held &= (i >= size) | (word[spot] == item[own])
            p, first, last, d = p[held], first[held], last[held], d[held]
            if n < SHORT:
                for y, z, b in zip(d.tolist(), p.tolist(), first.tolist()):
                    best.setdefault(y, (1.0, "copy", z - b - int(block.key_at[x[0]])))
                continue
            spot = p[:, None] + np.arange(1 - 2 * n, 2 * n)
            near = np.where((spot >= first[:, None]) & (spot < last[:, None]), word[np.clip(spot, 0, len(word) - 1)], 0)
            there = sum((near == w).any(axis=1).astype(np.int64) for w in item)
            p, first, last, d = (v[there >= PARAPHRASE * n] for v in (p, first, last, d))
            # Windows begin at multiples of a step from the document's beginning.
            step = max(1, n // 4)
            start = ((p - first) // step)[:, None] - np.arange(-(-2 * n // step) + 1)
            inside = (start >= 0) & (start * step + 2 * n > (p - first)[:, None])
            for y, s in np.unique(np.stack([np.broadcast_to(d[:, None], start.shape)[inside], start[inside]], axis=1), axis=0).tolist():
                b = int(begin[y]) + s * step
                share, kind = judge(block.item_words[k], word[b:min(b + 2 * n, int(begin[y + 1]))].tolist())
                if kind and share > best.get(y, (0.0,))[0]:
                    best[y] = (share, kind, s * step)
        out += [(ids[y], int(block.items[k]), *found) for y, found in sorted(best.items())]
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """doc_id, item_id, overlap, kind, first_word: one row for each document and benchmark item found in it.

    overlap: share of the item's words in the longest common subsequence. kind: copy or paraphrase. first_word: where the words
    that were compared begin. Null and empty texts (on either side) match nothing; items without an item_id and
    documents without a doc_id are left out; repeated rows count once; either table empty gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna()
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"),
                             F.col("text").cast("string").alias("text")).dropna().distinct()
    items = store(items.where(F.col("text").rlike(r"[\p{L}\p{N}]")), "items")
    schema = "doc_id bigint, item_id bigint, overlap double, kind string, first_word bigint"
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    idf = spark.sparkContext.broadcast(word_weights(texts))
    parts = -(-size["chars"] // PART_CHARS)
    out = None
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        cut = store(mine.select("item_id", "text").mapInArrow(_cut, "item_id bigint, text string, nth bigint, words binary"), "passages")
        whole = cut.where("nth < 0").orderBy("item_id", "text").select("item_id", "words").collect()  # at most PART_CHARS characters
        if not whole:
            continue
        item_words = [np.frombuffer(r["words"], np.uint64) for r in whole]
        vocabulary = np.unique(np.concatenate(item_words))
        passages = cut.where("nth >= 0")
        v = factorise(passages, passages.count(), spark.sparkContext.broadcast(vocabulary), idf)
        index = spark.sparkContext.broadcast(([r["item_id"] for r in whole], item_words, v, vocabulary))
        found = texts.mapInArrow(_searched(index, idf, cosine), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("overlap", "kind", "first_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.overlap", "b.kind", "b.first_word")
