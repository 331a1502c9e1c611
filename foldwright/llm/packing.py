"""Best-fit packing of tokenised documents by non-negative least squares over length patterns.

1. `tokenize` cuts documents into pieces of at most `size` tokens and writes them as a table, with each piece's number
   among the equal lengths of its task.
2. `plan` sees only the histogram of lengths (at most `size` bins, whatever the corpus): it enumerates the patterns of two
   or three lengths that fill a sequence, fits their repeat counts to the histogram by non-negative least squares, rounds
   them, and packs what is left best fit, longest first.
3. `place` gives every piece its sequence and offset from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.llm.common import store, text_slices, worker_cache

SIZE = 1024
END_ID = 2
PIECES = ("doc_id bigint, piece int, start bigint, length bigint, ids array<int>, ids_crc32 bigint, "
          "task int, nth bigint")


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the byte-level vocabulary, by rule: printable Latin-1 as itself, the rest from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _same_merges(path: str):
    """A faster engine (tiktoken) with the same merges and pattern, or None where the file is of another kind.

    Both merge the pair of least rank first. The ranks agree where the file is plain byte-level BPE and the k-th merge makes
    the k-th id after the 256 bytes.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel"
             and not before.get("add_prefix_space") and before.get("use_regex", True) and not model.get("ignore_merges"))
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    vocabulary = model["vocab"]
    if not plain or any(vocabulary.get("".join(m)) != 256 + k for k, m in enumerate(pairs)):
        return None
    byte = _byte_symbols()
    ranks = {bytes(byte[c] for c in token): k for token, k in vocabulary.items() if k < 256 + len(pairs)}
    return tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Encoder:
    """Ids of a whole text as bytes (little-endian unsigned 32 bit). Strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.engine = _same_merges(path)
        if self.engine is None:
            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True

    def __call__(self, text: str) -> bytes:
        if self.engine:
            return self.engine.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def _encoder(path: str) -> _Encoder:
    return worker_cache("encoder", path, lambda: _Encoder(path))


def _tokenized(path: str, size: int, end_id: int):
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = _encoder(path), TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for whole in batches:
            for part, texts in text_slices(whole, 1, 1_000_000):
                rows, raw = [], []
                for doc, text in zip(part.column(0).to_pylist(), texts):
                    ids = encoder(text) + end
                    n = len(ids) // 4
                    start, piece = 0, 0
                    while start < n:
                        stop = start + ((n - start) % size or size) if piece == 0 else start + size
                        raw.append(ids[4 * start:4 * stop])
                        rows.append((doc, piece, start, stop - start, zlib.crc32(raw[-1]), seen[stop - start]))
                        seen[stop - start] += 1
                        start, piece = stop, piece + 1
                doc, piece, start, length, crc, nth = zip(*rows)
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(raw), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat),
                    pa.array(crc, pa.int64()), pa.array(np.full(len(rows), task, dtype=np.int32)),
                    pa.array(nth, pa.int64()),
                ], names=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "nth"])

    return run


def tokenize(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces of every row's text, as a written table: PIECES.

    A document is its ids and end_id. Only one longer than `size` is cut, and its first piece holds the remainder.
    A null or empty text is the one id end_id. Repeated rows are packed as often as they occur. A null doc_id is kept.
    nth numbers the pieces of one length within a task; with the table written, both stay as they are.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return store(rows.mapInArrow(_tokenized(tokenizer, size, end_id), PIECES), "pieces")


# --- the plan, from the histogram alone ----------------------------------------------------------

def patterns(size: int) -> np.ndarray:
    """Every way to write size as two or three lengths a >= b >= c (c is 0 for two)."""
    out = []
    for c in range(size // 3 + 1):
        b = np.arange(max(c, 1), (size - c) // 2 + 1)
        out.append(np.stack([size - c - b, b, np.full(len(b), c)], axis=1))
    return np.concatenate(out)


def fit(counts: np.ndarray, rounds: int = 200, block: int = 48, close: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Repeat counts x >= 0 of patterns that bring A x close to the histogram (index: length).

    Active-set non-negative least squares: each round takes in the patterns with the largest positive gradient, solves
    the least squares on the patterns taken, and steps back to the border where a count would fall below zero. It ends
    when less than `close` of the pieces differ. The support never has more patterns than there are lengths, so rounding
    loses little.
    """
    size = len(counts) - 1
    every = patterns(size)
    goal = counts.astype(float).copy()
    goal[[0, size]] = 0
    weight = np.ones(size + 1)
    weight[1:max(2, size // 16)] = 0.3  # short pieces fit anywhere later
    weight[0] = 0
    present = (goal[every[:, 0]] > 0) & (goal[every[:, 1]] > 0) & ((every[:, 2] == 0) | (goal[every[:, 2]] > 0))
    every = every[present]
    if not len(every):
        return every, np.zeros(0)

    def columns(taken):
        a = np.zeros((size + 1, len(taken)))
        for k in range(3):
            np.add.at(a, (every[taken, k], np.arange(len(taken))), 1.0)
        a[0] = 0
        return a * weight[:, None]

    taken, x, target = np.zeros(0, dtype=int), np.zeros(0), goal * weight
    for _ in range(rounds):
        rest = target - columns(taken) @ x if len(taken) else target
        if np.abs(rest).sum() <= close * target.sum():
            break
        rest = rest * weight
        slope = rest[every[:, 0]] + rest[every[:, 1]] + np.where(every[:, 2] > 0, rest[every[:, 2]], 0)
        slope[taken] = -np.inf
        best = np.argsort(-slope, kind="stable")[:8 * block]
        fresh, used = [], set()
        for p in best[slope[best] > 1e-6 * max(1.0, goal.max())].tolist():
            if not used & set(every[p].tolist()) - {0}:  # no length twice: these columns are independent
                fresh.append(p)
                used.update(every[p].tolist())
            if len(fresh) == block:
                break
        fresh = fresh[:max(0, size - len(taken))]
        if not fresh:
            break
        taken, x = np.append(taken, fresh), np.append(x, np.zeros(len(fresh)))
        while len(taken):
            a = columns(taken)
            z = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(taken)), a.T @ target)
            low = z <= 0
            if not low.any():
                x = z
                break
            step = np.min(np.where(low, x / np.maximum(x - z, 1e-300), 1.0))
            x = x + step * (z - x)
            keep = ~(low & (x <= 1e-9))
            if keep.all():
                keep[np.argmin(np.where(low, x, np.inf))] = False
            taken, x = taken[keep], x[keep]
    return every[taken], x


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on the histogram: [(lengths, repeats)]. Equal sequences are one entry."""
    by_space: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            space = next((s for s in range(length, size) if by_space.get(s)), None)
            if space is None:
                each = size // length
                for n, repeats in ((each, left // each), (left % each, 1 if left % each else 0)):
                    if repeats:
                        by_space.setdefault(size - n * length, []).append(((length,) * n, repeats))
                left = 0
                continue
            lengths, repeats = by_space[space].pop()
            n = min(space // length, left)
            filled = min(repeats, left // n)
            by_space.setdefault(space - n * length, []).append((lengths + (length,) * n, filled))
            if filled < repeats:
                by_space[space].append((lengths, repeats - filled))
            left -= filled * n
    return [g for groups in by_space.values() for g in groups]


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a sequence, number of such sequences)] using every piece once. counts: index is the length."""
    size, left, out = len(counts) - 1, counts.astype(np.int64).copy(), []
    full, left[size] = int(left[size]), 0
    lengths, x = fit(left)
    for k in np.argsort(-x, kind="stable"):
        need = {int(v): int((lengths[k] == v).sum()) for v in set(lengths[k].tolist()) - {0}}
        repeats = min([int(round(x[k])), *(left[v] // n for v, n in need.items())])
        if repeats > 0:
            out.append((tuple(int(v) for v in lengths[k] if v), int(repeats)))
            for v, n in need.items():
                left[v] -= repeats * n
    return out + best_fit(left, size) + ([((size,), full)] if full else [])


def _slots(groups: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted runs: key = length << 44 | first rank of its length, first sequence, offset in it."""
    cursor: dict[int, int] = {}
    key, sequence, offset, base = [], [], [], 0
    for lengths, repeats in groups:
        at = 0
        for length in lengths:
            key.append((length << 44) | cursor.get(length, 0))
            sequence.append(base)
            offset.append(at)
            cursor[length] = cursor.get(length, 0) + repeats
            at += length
        base += repeats
    key = np.array(key, dtype=np.int64)
    order = np.argsort(key, kind="stable")
    return key[order], np.array(sequence, dtype=np.int64)[order], np.array(offset, dtype=np.int64)[order]


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to pieces that carry length, task and nth (dropped here).

    The histogram (at most `size` rows) is all that reaches the driver. Ranks come from counts per task and length.
    """
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task and length; a length's window holds as many rows as there were tasks.
    first = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    counts = np.zeros(size + 1, dtype=np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    key, sequence, offset = _slots(plan(counts))

    def placed(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            run = np.searchsorted(key, (length << 44) | rank, side="right") - 1
            at = rank - (key[run] & ((1 << 44) - 1)) if len(run) else rank
            yield pa.RecordBatch.from_arrays(
                [c for n, c in zip(b.schema.names, b.columns) if n != "_rank"]
                + [pa.array(sequence[run] + at), pa.array(offset[run])],
                names=[n for n in b.schema.names if n != "_rank"] + ["sequence_id", "offset"])

    ranked = pieces.join(first, ["length", "task"]).withColumn("_rank", F.col("nth") + F.col("_first"))
    ranked = ranked.drop("task", "nth", "_first")
    names = [c for c in ranked.columns if c != "_rank"]
    schema = T.StructType([*ranked.select(names).schema, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    return ranked.select(*names, "_rank").mapInArrow(placed, schema)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset: every piece and its place.

    Sequences have no gaps. An empty table gives an empty result.
    """
    return place(tokenize(docs, tokenizer, size, end_id), size)
