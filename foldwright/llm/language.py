"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A document is parsed against it: each
phrase is the longest stretch that occurs somewhere in the sample, and the next phrase starts where it ends. Few phrases
mean that the document is built from the sample's material; phrases * log2(sample length) / length estimates the
cross-entropy in bits per character, and the language with the least wins.

Text is lower-cased; runs of anything but letters count as one separator. Texts are parsed whole, in blocks of BLOCK
characters (a block's first phrase starts afresh), all blocks of a batch side by side in numpy: one table look-up per
character and language.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.llm.common import text_slices, worker_cache

UNDETERMINED = "und"
BLOCK = 256
_SEPARATOR = 0


def held_out(key: str = "doc_id") -> Column:
    """The quarter of documents that nothing is learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def normalize(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (state, code point, next state) of the automaton of all substrings; state 0 is the root."""
    link, longest, nxt = [-1], [0], [{}]
    last = 0
    for c in text:
        new = len(nxt)
        nxt.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    edges = [(s, ord(c), t) for s, to in enumerate(nxt) for c, t in to.items()]
    state, code, to = zip(*edges) if edges else ((), (), ())
    return tuple(np.array(x, dtype=np.int32) for x in (state, code, to))


@dataclass
class Model:
    """Learned from at most languages * sample_chars characters; its size does not depend on the corpus."""

    languages: list[str]
    lengths: list[int]
    edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def key(self) -> str:
        h = hashlib.sha256(repr((self.languages, self.lengths)).encode())
        for e in self.edges:
            for a in e:
                h.update(a.tobytes())
        return h.hexdigest()


def fit(docs: DataFrame, sample_rows: int = 192, window: int = 320, sample_chars: int = 49_152,
        full_samples: int = 64, least_rows: int = 4) -> Model:
    """Learn every value of lang from rows with text, lang and doc_id outside the held-out quarter.

    The sample is bounded: sample_rows rows of each value, chosen by a hash of doc_id, and of each row a window of `window`
    characters at a hashed place, at most sample_chars characters per value. With more than full_samples values all samples
    shrink so that together they stay as large; values too many for least_rows rows each are an error.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    most = full_samples * sample_rows // least_rows
    top = counts.orderBy("lang").limit(most + 1).collect()
    if not top:
        return Model([], [], [])
    if len(top) > most:
        raise ValueError(f"more than {most} values of lang")
    if len(top) > full_samples:
        sample_chars = sample_chars * full_samples // len(top)
        sample_rows = sample_rows * full_samples // len(top)
    # About twice as many rows as needed pass the hash, whatever a language's size; the window takes the first.
    share = F.create_map(*[F.lit(x) for r in top for x in (r["lang"], 2.0 * sample_rows / r["n"])])
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) / 1_000_003
    order = F.xxhash64("doc_id", F.lit(7))
    begin = (F.pmod(F.xxhash64("doc_id", F.lit(13)), F.greatest(F.length("text") - window, F.lit(1))) + 1).cast("int")
    chosen = (rows.where(place < share[F.col("lang")])
              .select("lang", order.alias("_order"), "doc_id", F.substr("text", begin, F.lit(window)).alias("part")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_order", "doc_id", "part"))
    chosen = chosen.withColumn("_rank", rank).where(F.col("_rank") <= sample_rows)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        parts = [normalize(p) for p in group.sort_values("_rank")["part"]]
        text = " ".join(p for p in parts if p)[:sample_chars]
        edges = suffix_automaton(text)
        return pd.DataFrame([[group["lang"].iloc[0], len(text), *(e.tobytes() for e in edges)]],
                            columns=["lang", "length", "state", "code", "to"])

    built = chosen.groupBy("lang").applyInPandas(
        build, "lang string, length bigint, state binary, code binary, to binary").collect()
    built = sorted((r for r in built if r["length"]), key=lambda r: r["lang"])
    return Model([r["lang"] for r in built], [r["length"] for r in built],
                 [tuple(np.frombuffer(r[c], dtype=np.int32) for c in ("state", "code", "to")) for r in built])


class _Parser:
    def __init__(self, model: Model):
        codes = np.unique(np.concatenate([e[1] for e in model.edges]))
        letters = codes[codes != ord(" ")]
        self.unknown, self.pad = len(letters) + 1, len(letters) + 2
        # Class of every code point: separator, a letter of the samples, or a letter in none of them.
        self.classes = np.fromiter((self.unknown if chr(c).isalpha() else _SEPARATOR for c in range(sys.maxunicode + 1)),
                                   dtype=np.uint16, count=sys.maxunicode + 1)
        self.classes[letters] = np.arange(1, len(letters) + 1)
        self.width = width = len(letters) + 3
        self.bits = [np.log2(max(n, 2)) for n in model.lengths]
        self.tables = []
        for state, code, to in model.edges:
            n = int(max(state.max(), to.max())) + 1
            nxt = np.full((n, width), -1, dtype=np.int32)
            nxt[state, np.where(code == ord(" "), _SEPARATOR, self.classes[code])] = to
            root = np.maximum(nxt[0], 0)
            # An entry is 2 * (offset of the next state) + 1 where a phrase ends before this character.
            table = np.where(nxt >= 0, 2 * width * nxt, 2 * width * root[None, :] + 1)
            table[0] = np.where(nxt[0] >= 0, 2 * width * nxt[0], 1)
            table[:, self.pad] = 2 * width * np.arange(n)
            self.tables.append(table.astype(np.int32).ravel())

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per text and language, and characters per text after normalising."""
        lowered = [t.lower() for t in texts]
        size = np.array([len(t) for t in lowered])
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = self.classes[codes]
        owner = np.repeat(np.arange(len(texts)), size)
        before = np.concatenate([[_SEPARATOR], c[:-1]])
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        before[starts[size > 0]] = _SEPARATOR
        keep = (c != _SEPARATOR) | (before != _SEPARATOR)
        c, owner = c[keep], owner[keep]
        n = np.bincount(owner, minlength=len(texts))
        blocks = -(-n // BLOCK)
        first_block = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        at = np.arange(len(c)) - np.concatenate([[0], np.cumsum(n)[:-1]])[owner]
        grid = np.full((BLOCK, int(blocks.sum())), self.pad, dtype=np.int32)
        grid[at % BLOCK, first_block[owner] + at // BLOCK] = c
        of_block = np.repeat(np.arange(len(texts)), blocks)
        out = np.empty((len(texts), len(self.tables)))
        index, entry = np.empty(grid.shape[1], dtype=np.int32), np.empty(grid.shape[1], dtype=np.int32)
        for k, table in enumerate(self.tables):
            state = np.zeros(grid.shape[1], dtype=np.int32)
            ended = np.ones(grid.shape[1], dtype=np.int32)  # the phrase that the block's end cuts
            for row in grid:
                np.add(state, row, out=index)
                np.take(table, index, out=entry, mode="wrap")
                np.right_shift(entry, 1, out=state)
                np.bitwise_and(entry, 1, out=entry)
                np.add(ended, entry, out=ended)
            out[:, k] = np.bincount(of_block, weights=ended, minlength=len(texts))
        return out, n


def _predict(sent, key: str, judged: str, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        parser = worker_cache("language", key, lambda: _Parser(model)) if model.languages else None
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            for rows, part in text_slices(batch, judged):
                best, score, bits = np.full(len(part), -1), np.zeros(len(part)), np.full(len(part), np.nan)
                if parser:
                    count, n = parser.phrases(part)
                    known = np.flatnonzero(n)
                    if len(known):
                        h = count[known] * np.array(parser.bits) / n[known][:, None]
                        order = np.argsort(h, axis=1, kind="stable")
                        least = np.take_along_axis(h, order[:, :1], 1)[:, 0]
                        second = np.take_along_axis(h, order[:, 1:2], 1)[:, 0] if h.shape[1] > 1 else np.full(len(h), np.inf)
                        best[known], bits[known] = order[:, 0], least
                        score[known] = np.clip(1 - least / np.maximum(second, 1e-12), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in carried], pa.array(names[best], pa.string()), pa.array(score),
                     pa.array(bits, mask=np.isnan(bits))],
                    names=[*carried, "lang_pred", "score", "bits"])

    return run


def identify(docs: DataFrame, model: Model, keep: Sequence[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits for every row, from the whole text.

    keep names the columns of docs to carry along instead of doc_id and held_out.

    lang_pred: a learned language (the first by name on a tie), or `und` where the text is null or has no letter, or
    nothing was learned. score: 1 - least / second least cross-entropy; 0 for `und`, 1 with a single language. bits: the least
    cross-entropy in bits per character, null for `und`. Repeated rows give repeated results.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.lengths, model.edges))
    if keep is None:
        carried = [F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out")]
    else:
        carried = [F.col(f"`{c}`") for c in keep if c not in ("lang_pred", "score", "bits")]
    schema = docs.select(*carried).schema
    names = list(schema.names)
    # A text that is carried along anyway is sent to Python once.
    judged = "text" if "text" in names and dict(docs.dtypes)["text"] == "string" else "_judged_text"
    rows = docs.select(*carried, *([] if judged == "text" else [F.col("text").cast("string").alias(judged)]))
    for name, kind in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("bits", T.DoubleType())):
        schema = schema.add(name, kind)
    return rows.mapInArrow(_predict(sent, model.key(), judged, names), schema)
