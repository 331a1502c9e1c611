"""Secret scan: three fixed patterns, and random-looking strings found by a battery of randomness tests.

Candidates are runs of `[A-Za-z0-9+/_-]` (with `=` padding) whose inferred encoding, the smallest alphabet that holds all of
their characters, could carry LEAST_BITS bits at their length. Each is tested against "every symbol is drawn evenly and
independently": chi-squared over bins of the alphabet (at least five characters expected in a bin), runs above and below the
alphabet's middle, and serial correlation of neighbours. Fisher's method joins the three p-values to one.

How often ordinary text passes the battery depends on the alphabet and the length, so it is measured on the whole corpus:
outside candidates every document's text, read in an alphabet (other symbols left out), is cut into strings of the least length of
a class, and the battery runs on them (decoys), for every pair of alphabet and class. In each cell (alphabet, length class) the
share of decoys that look at least as random as a candidate is the candidate's p-value for "this is ordinary text", and
Benjamini-Hochberg over all candidates of the corpus keeps the share of ordinary strings among the reported ones below RATE. Where a cell has few decoys
no p-value gets small and nothing is reported: short strings of small alphabets are never called secrets on thin evidence.

Per cell and step of the combined p-value two counts are kept, so the driver sees a table of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from math import erfc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import store, text_slices

# The three patterns, and the fewest characters of what each one checks.
_ASSIGN = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS, _HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
KINDS = {"assign": 6, "access": 20, "hex": 24}
RANDOM = "random"

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Smaller alphabets first; the order of symbols is the order in which bins and neighbours are taken.
ALPHABETS = {
    "decimal": _DIGITS, "hex": _DIGITS + _LOWER[:6], "HEX": _DIGITS + _UPPER[:6], "lower": _LOWER, "upper": _UPPER,
    "base32": _UPPER + _DIGITS[2:8], "base36": _DIGITS + _LOWER, "BASE36": _DIGITS + _UPPER, "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _DIGITS + _UPPER + _LOWER + "+/", "base64url": _DIGITS + _UPPER + _LOWER + "-_",
    "any": _DIGITS + _UPPER + _LOWER + "+/-_",
}
LEAST_CHARS, LEAST_BITS, RATE = 16, 80, 0.01
#: Lower ends of the length classes. Decoys have the least length of their class, at which they pass most easily.
LENGTHS = (16, 20, 24, 32, 40, 48, 64, 96, 128, 256)
#: Steps of the combined p-value, four for each power of ten.
STEPS, _PER_TEN = 64, 4
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_CHARS)
_PATTERNS = {"assign": re.compile(_ASSIGN), "access": re.compile(_ACCESS), "hex": re.compile(r"[0-9a-f]{%d,}" % KINDS["hex"])}
_NAMES, _SIZES = list(ALPHABETS), [len(a) for a in ALPHABETS.values()]
_ONE_CASE = {"hex", "HEX", "lower", "upper", "base32", "base36", "BASE36"}


def _ranks(alphabet: str, both_cases: bool) -> np.ndarray:
    table = np.full(256, -1, dtype=np.int16)
    for i, c in enumerate(alphabet):
        for form in {c, c.upper(), c.lower()} if both_cases else {c}:
            table[ord(form)] = i
    return table


_EXACT = {n: _ranks(a, False) for n, a in ALPHABETS.items()}
_FOLDED = {n: _ranks(a, n in _ONE_CASE) for n, a in ALPHABETS.items()}
_MEMBER = [frozenset(a) for a in ALPHABETS.values()]


#: -ln erfc(z / sqrt 2) at steps of 1 / _GRID from _LOW to _HIGH; between two steps it is all but linear.
_GRID, _LOW, _HIGH = 2048, -8, 36
_MINUS_LOG = np.array([-np.log(erfc(i / _GRID / np.sqrt(2.0))) for i in range(_LOW * _GRID, _HIGH * _GRID + 2)])


def _minus_log(z: np.ndarray) -> np.ndarray:
    at = (np.clip(z, _LOW, _HIGH) - _LOW) * _GRID
    i = at.astype(np.int64)
    low = _MINUS_LOG[i]
    return low + (at - i) * (_MINUS_LOG[i + 1] - low)


def _minus_log_runs(runs: np.ndarray, n: int) -> np.ndarray:
    """-ln of the p-value of so many changes between the halves of the alphabet in n symbols."""
    return _minus_log(np.abs(runs - (n - 1) / 2) / np.sqrt((n - 1) / 4))


#: By length and number of changes.
_RUNS = {n: _minus_log_runs(np.arange(n), n) for n in LENGTHS}


@lru_cache(1024)
def _bins(n: int, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of bins for n symbols, bin of every symbol, share of the symbols in every bin."""
    bins = max(2, min(n // 5, size))
    of = np.arange(size) * bins // size
    return bins, of, np.bincount(of, minlength=bins) / size


def _combined(seen: np.ndarray, runs: np.ndarray, serial: np.ndarray, n: int, size: int) -> np.ndarray:
    """Combined p-value of strings of n symbols: symbols seen in every bin, _minus_log_runs of the string, sum of the products of
    neighbours about the middle."""
    bins, _, share = _bins(n, size)
    chi = (seen * seen) @ (1 / share) / n - n
    d = bins - 1  # Wilson and Hilferty: the cube root is close to normal
    z = (np.cbrt(np.maximum(chi, 0.0) / d) - (1 - 2 / (9 * d))) / np.sqrt(2 / (9 * d))
    half = _minus_log(z) + np.log(2.0)
    half += runs
    half += _minus_log(np.abs(serial / ((size * size - 1) / 12 * np.sqrt(n - 1))))
    return np.exp(-half) * (1 + half + half * half / 2)


def battery(x: np.ndarray, size: int) -> np.ndarray:
    """Combined p-value of every row of symbol ranks (all rows of one length, 16 or more) under even independent symbols."""
    m, n = x.shape
    bins, of, _ = _bins(n, size)
    seen = np.bincount((np.arange(m)[:, None] * bins + of[x]).ravel(), minlength=m * bins).reshape(m, bins)
    high = x >= size // 2  # every alphabet has an even number of symbols
    runs = (high[:, 1:] != high[:, :-1]).sum(axis=1)
    centred = x - (size - 1) / 2
    return _combined(seen.astype(float), _minus_log_runs(runs, n), (centred[:, 1:] * centred[:, :-1]).sum(axis=1), n, size)


def step(p: np.ndarray) -> np.ndarray:
    return np.minimum(-np.log10(np.maximum(p, 1e-300)) * _PER_TEN, STEPS - 1).astype(np.int64)


def encoding(token: str) -> int | None:
    """Number of the smallest alphabet that holds the token's characters (without padding)."""
    symbols = set(token)
    return next((i for i, a in enumerate(_MEMBER) if symbols <= a), None)


def length_class(n: int) -> int:
    return int(np.searchsorted(LENGTHS, n, side="right")) - 1


def _cell(alphabet: int, n: int) -> int:
    return alphabet * len(LENGTHS) + length_class(n)


CELLS = len(ALPHABETS) * len(LENGTHS)


def _testable(alphabet: int, n: int) -> bool:
    return n >= LEAST_CHARS and n * np.log2(_SIZES[alphabet]) >= LEAST_BITS


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, cell, step) of every run that is long enough for its encoding."""
    found = []
    for m in _RUN.finditer(text):
        body = m.group().rstrip("=")
        alphabet = encoding(body)
        if alphabet is None or not _testable(alphabet, len(body)):
            continue
        x = _EXACT[_NAMES[alphabet]][np.frombuffer(body.encode(), dtype=np.uint8)][None, :]
        found.append((m.start(), m.end(), _cell(alphabet, len(body)), int(step(battery(x, _SIZES[alphabet]))[0])))
    return found


def _alike() -> list[tuple[list[int], bytes, bytes]]:
    """(alphabets that read a text in one way, ranks of all bytes, bytes left out): upper and lower case of one alphabet give the
    same decoys."""
    found: dict[bytes, list[int]] = {}
    for i, name in enumerate(_NAMES):
        found.setdefault(_FOLDED[name].tobytes(), []).append(i)
    every = [(same, _FOLDED[_NAMES[same[0]]]) for same in found.values()]
    return [(same, np.maximum(ranks, 0).astype(np.uint8).tobytes(), np.flatnonzero(ranks < 0).astype(np.uint8).tobytes()) for same, ranks in every]


_READINGS = _alike()


def _count(hits: np.ndarray) -> np.ndarray:
    """Number of hits in every column, summed in 8 bits as long as they hold it."""
    ones = hits.view(np.uint8)
    total = np.add.reduce(ones[:255], axis=0, dtype=np.uint8)
    return total if len(ones) <= 255 else total + ones[255:].sum(axis=0, dtype=np.int16)


def _many(x: np.ndarray, size: int) -> np.ndarray:
    """battery() for many rows of one of LENGTHS, ranks in 8 bits: every step runs along the rows, a place in all of them at a time."""
    x = np.ascontiguousarray(x.T)
    n, m = x.shape
    bins, of, _ = _bins(n, size)
    above = np.zeros((bins + 1, m), dtype=np.int16)  # symbols in a bin or in a later one
    above[0] = n
    for i, least in enumerate(np.searchsorted(of, np.arange(1, bins)).tolist(), 1):
        above[i] = _count(x >= least)
    seen = (above[:-1] - above[1:]).astype(float)
    high = x >= size // 2
    centred = x.astype(np.float32)  # sums of products are whole quarters below 2 ** 19: exact in 32 bits
    centred -= (size - 1) / 2
    serial = np.einsum("ij,ij->j", centred[1:], centred[:-1]).astype(float)
    return _combined(seen.T, _RUNS[n][_count(high[1:] != high[:-1])], serial, n, size)


def decoys(texts: Sequence[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, steps) of the strings that every text is cut into, without its candidates, for every cell.

    The strings of all texts are tested at once; a string never spans two texts.
    """
    rest = [_RUN.sub("", t).encode("utf-8", "replace") for t in texts]
    for same, ranks, others in _READINGS:
        kept = [r.translate(ranks, others) for r in rest]
        for n in LENGTHS:
            if not _testable(same[0], n):
                continue
            whole = b"".join([k[:len(k) // n * n] for k in kept])
            if whole:
                steps = step(_many(np.frombuffer(whole, dtype=np.uint8).reshape(-1, n), _SIZES[same[0]]))
                for a in same:
                    yield _cell(a, n), steps


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns, leftmost and without overlap in each kind, in order."""
    found = [(m.start(), 0, m.end()) for m in _PATTERNS["assign"].finditer(text) if len(m.group(2)) >= KINDS["assign"]]
    found += [(m.start(), 1, m.end()) for m in _PATTERNS["access"].finditer(text) if len(m.group()) >= KINDS["access"]]
    found += [(m.start(), 2, m.end()) for m in _PATTERNS["hex"].finditer(text)]
    return sorted(found)


_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
_FOUND = f"base {_SPAN}, tried array<struct<start:bigint,end:bigint,cell:int,step:int>>, targets array<bigint>, decoys array<bigint>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_TRIED = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("cell", pa.int32()), ("step", pa.int32())]))
_COUNTS = pa.list_(pa.int64())


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and as the task's last row its counts of candidates and decoys by cell and step."""
    targets, ordinary = np.zeros((2, CELLS * STEPS), dtype=np.int64)
    id_type = None
    for b in batches:
        id_type = b.column("doc_id").type
        for part, texts in text_slices(b, "text"):
            base, tried = [], []
            for text in texts:
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in patterns(text)])
                tried.append([{"start": s, "end": e, "cell": c, "step": p} for s, e, c, p in candidates(text)])
                for t in tried[-1]:
                    targets[t["cell"] * STEPS + t["step"]] += 1
            for cell, steps in decoys(texts):
                ordinary[cell * STEPS:(cell + 1) * STEPS] += np.bincount(steps, minlength=STEPS)
            none = pa.nulls(len(texts), _COUNTS)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(base, _SPANS), pa.array(tried, _TRIED), none, none],
                                             ["doc_id", "base", "tried", "targets", "decoys"])
    if id_type is not None:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, _SPANS), pa.nulls(1, _TRIED), pa.array([targets], _COUNTS),
                                          pa.array([ordinary], _COUNTS)], ["doc_id", "base", "tried", "targets", "decoys"])


def reported_steps(targets: np.ndarray, ordinary: np.ndarray, rate: float = RATE) -> np.ndarray:
    """Largest step reported per cell, -1 for none: Benjamini-Hochberg over the candidates of all cells.

    targets, ordinary: counts by (cell, step). A candidate's p-value is the share of its cell's decoys, itself added, that
    look at least as random.
    """
    p = (1 + ordinary.cumsum(axis=1)) / (1 + ordinary.sum(axis=1, keepdims=True))
    total = targets.sum()
    level = 0.0
    values, at = np.unique(p, return_inverse=True)
    found = np.bincount(at.ravel(), weights=targets.ravel(), minlength=len(values)).cumsum()
    good = np.flatnonzero((found > 0) & (values * total <= rate * found))
    if len(good):
        level = values[good[-1]]
    return (p <= level).sum(axis=1) - 1


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, RANDOM]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base and spans (arrays of start, kind, end in code points) for every row of docs.

    A null text is empty; repeated rows and null ids each give their row; an empty table gives an empty result. Texts are read
    whole. kind: 0 assign, 1 access, 2 hex, 3 random.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = store(rows.mapInArrow(_examine, f"doc_id {dict(rows.dtypes)['doc_id']}, {_FOUND}"), "secrets")
    counts = found.where(F.col("targets").isNotNull()).select(F.posexplode(F.arrays_zip("targets", "decoys")).alias("at", "n"))
    counts = counts.groupBy("at").agg(F.sum("n.targets").alias("t"), F.sum("n.decoys").alias("d")).where("t + d > 0").collect()
    tables = np.zeros((2, CELLS * STEPS), dtype=np.int64)
    for r in counts:  # at most CELLS * STEPS rows
        tables[:, r["at"]] = r["t"], r["d"]
    most = reported_steps(*tables.reshape(2, CELLS, STEPS), rate)
    limits = F.array(*[F.lit(int(v)) for v in most])
    random = F.transform(F.filter("tried", lambda t: t["step"] <= F.get(limits, t["cell"])), lambda t: F.struct(
        t["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), t["end"].alias("end")))
    out = found.where(F.col("targets").isNull()).select("doc_id", "base", F.sort_array(F.concat("base", random)).alias("spans"))
    def of_kind(i):
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint")

    return out.select("doc_id", *[of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], "base", "spans")


def digests(found: DataFrame) -> DataFrame:
    """Base and all spans as kind:start:end, joined by commas; the base as its SHA-256."""
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
                        _text_of(F.col("spans")).alias("spans"))
