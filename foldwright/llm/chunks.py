"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends at the white space whose hash is the least of any GAP in a row (the last
one of equals). That depends on at most GAP words to either side and never on the cut before, so after an insertion the cuts fall
at the same words again, no chunk is longer than GAP words, and a text that repeats itself within GAP words is cut at each turn.
Chunks are compared by a 64-bit digest of a stretch: the chunk and as many after it as make SEED_WORDS words. Two passages of 50
equal words therefore share a whole stretch, whatever stands before and after them. Stretches that also begin elsewhere form
chains, neighbours at one distance from their first places. Every chain's digest of 128 bits is compared with the first place's
and the words around it byte by byte in both directions, so a passage is reported with its full length.

The copy in the document with the smallest doc_id is the first one and stays; passages are reported in the others. Offsets count
bytes of the UTF-8 text. Words are runs of anything but ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.llm.common import store

WINDOW = 16
PASSAGE_WORDS = 50
SEED_WORDS = 14
GAP = 13
REACH = 1024  # bytes around a chain that are compared before whole texts are
_BATCH_BYTES = 1_500_000
_STRETCH = "digest bigint, doc_id bigint, tag int, at bigint, place bigint"
_CHAIN = ("doc_id bigint, tag int, start int, stop int, word int, stop_word int, next_start int, first_doc bigint, "
          "first_start int")


def gear_table(seed: int = 1) -> np.ndarray:
    """256 numbers by rule: the seeded generator's first values."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of table[data[i - j]] << j over the last WINDOW bytes, modulo 2**16, by doubling."""
    h, span = gear_table()[data], 1
    while span < WINDOW:
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] << np.uint16(span)
        h = h + shifted
        span *= 2
    return h


def _least(values: np.ndarray, first_word: np.ndarray, gap: int) -> np.ndarray:
    """Places that hold the least value of some gap places in a row of one text, the last one of equals; ascending."""
    apart, low = gap - 1, (1 << 32) - 1
    n, empty = len(values), np.iinfo(np.int64).max
    # Between texts stand gap - 1 empty places, so that no run of gap places sees two texts.
    text = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    keys = np.full(n + apart * len(first_word), empty)
    keys[np.arange(n) + apart * (text + 1)] = (values.astype(np.int64) << 32) | (low - np.arange(n))
    span = 1
    while span < gap:
        step = min(span, gap - span)
        keys = np.minimum(keys[:-step], keys[step:])
        span += step
    return np.unique(low - (keys[keys != empty] & low))


def cut(texts: list[bytes], gap: int = GAP) -> list[list[tuple[int, int, int]]]:
    """Chunks (start, stop, words) of every text, none longer than gap words."""
    lead = b" " * WINDOW  # every text begins in the same context
    data = np.frombuffer(b"".join([lead + t for t in texts]) + b" ", dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(blank & ~np.concatenate([[True], blank[:-1]]))
    offsets = np.cumsum([0] + [len(t) + WINDOW for t in texts])
    first_word = np.searchsorted(begins, offsets)
    candidates = _least(gear(data)[ends], first_word, gap) + 1
    bounds = np.searchsorted(candidates, first_word, side="right")
    begins, ends, candidates = begins.tolist(), ends.tolist(), candidates.tolist()
    out = []
    for k in range(len(texts)):
        base, last, end = int(offsets[k]) + WINDOW, int(first_word[k]), int(first_word[k + 1])
        chunks = []
        for c in [*candidates[bounds[k]:bounds[k + 1]], end]:
            if c > last:
                chunks.append((begins[last] - base, ends[c - 1] - base, c - last))
                last = c
        out.append(chunks)
    return out


def stretches(chunks: list[tuple[int, int, int]], seed_words: int) -> list[tuple[int, int, int, int, int]]:
    """(nth, start, stop, word, stop_word): from each chunk on, the fewest chunks with at least seed_words words; the last
    stretch reaches the end of the text."""
    before, total = [], 0
    for c in chunks:
        before.append(total)
        total += c[2]
    before.append(total)
    out, last = [], 0
    for k, (start, _, _) in enumerate(chunks):
        while last < len(chunks) and before[last + 1] - before[k] < seed_words:
            last += 1
        if last == len(chunks):
            if out and out[-1][2] < chunks[-1][1]:  # the stretch that reaches the end
                out.append((k, chunks[k - 1][0], chunks[-1][1], before[k - 1], total))
            break
        out.append((k, start, chunks[last][1], before[k], before[last + 1]))
    return out


def _packed(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers per stretch, so that little is shuffled: (start, stop) and (nth, word, number of words)."""
    nth, start, stop, word, stop_word = flat.T
    return (start << 32) | stop, (nth << 35) | (word << 6) | (stop_word - word)


def _unpacked(df: DataFrame) -> DataFrame:
    low32 = F.lit((1 << 32) - 1)
    word = F.shiftright("place", 6).bitwiseAND(F.lit((1 << 29) - 1))
    return df.select(
        *[c for c in df.columns if c not in ("at", "place")], F.shiftright("place", 35).cast("int").alias("nth"),
        F.shiftright("at", 32).cast("int").alias("start"), F.col("at").bitwiseAND(low32).cast("int").alias("stop"),
        word.cast("int").alias("word"), (word + F.col("place").bitwiseAND(F.lit(63))).cast("int").alias("stop_word"))


def _stretched(seed_words: int, gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) <= _BATCH_BYTES):
                    size += len(texts[end])
                    end += 1
                part = texts[begin:end]
                found = [stretches(c, seed_words) for c in cut(part, gap)]
                digest = np.array([xxhash.xxh3_64_intdigest(t[x[1]:x[2]]) for t, xs in zip(part, found) for x in xs],
                                  dtype=np.uint64).view(np.int64)
                text = np.repeat(np.arange(len(part)), [len(xs) for xs in found])
                flat = np.array([x for xs in found for x in xs], dtype=np.int64).reshape(-1, 5)
                # Where a text goes round in a loop, stretch after stretch is the same: one of them is enough.
                kept = np.ones(len(text), dtype=bool)
                kept[1:] = (text[1:] != text[:-1]) | (digest[1:] != digest[:-1])
                digest, text, flat = digest[kept], text[kept], flat[kept]
                flat[:, 0] = np.arange(len(text)) - np.searchsorted(text, text)
                yield pa.RecordBatch.from_arrays([
                    pa.array(digest), pa.array(np.array(ids[begin:end], dtype=np.int64)[text]),
                    pa.array(np.array(tags[begin:end], dtype=np.int32)[text]), *[pa.array(x) for x in _packed(flat)],
                ], names=["digest", "doc_id", "tag", "at", "place"])
                begin = end

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, tag, data for rows with a doc_id and text. tag tells texts with one doc_id apart."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", F.hash("text").alias("tag"), F.col("text").cast("binary").alias("data"))


def chunk(docs: DataFrame, seed_words: int = SEED_WORDS, gap: int = GAP) -> DataFrame:
    """One row per stretch: digest, doc_id, tag, and packed its extent and place (see _unpacked); of equal stretches one after
    another the first. Null and short texts have none."""
    if seed_words + gap > 63:
        raise ValueError("a stretch must hold fewer than 64 words")
    return _texts(docs).mapInArrow(_stretched(seed_words, gap), _STRETCH)


_CHAIN_NAMES = ["doc_id", "tag", "start", "stop", "word", "stop_word", "next_start", "first_doc", "first_start"]
_CHAIN_TYPES = [pa.int64(), *[pa.int32()] * 6, pa.int64(), pa.int32()]


def chains_of(hits: list[dict], passage_words: int) -> list[dict]:
    """Chains among a document's repeated stretches, in text order; next_start is where the next one begins that has the same
    distance from the same first document, if any.

    Where a text repeats itself, first places jump back; a chain that begins at a first place seen before in its run of
    neighbours is left out unless it is a passage, because the texts are compared from the earlier one on.
    """
    out, chain, last, seen = [], None, None, set()

    def close():
        if chain and (chain["new"] or chain["stop_word"] - chain["word"] >= passage_words):
            out.append(chain)

    for h in hits:
        neighbour = last and h["nth"] == last["nth"] + 1 and h["first_doc"] == last["first_doc"]
        if not neighbour:
            seen = set()
        if neighbour and h["start"] - h["first_start"] == last["start"] - last["first_start"]:
            chain.update(stop=h["stop"], stop_word=h["stop_word"])
        else:
            close()
            chain = dict(h, new=h["first_start"] not in seen)
        seen.add(h["first_start"])
        last = h
    close()
    following = {}
    for chain in reversed(out):
        line = chain["first_doc"], chain["first_start"] - chain["start"]
        chain["next_start"] = following.get(line)
        following[line] = chain["start"]
    return out


def _chains(passage_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc, tag, *(chain[c] for c in _CHAIN_NAMES[2:])) for doc, tag, hits in zip(*(c.to_pylist() for c in batch.columns))
                   for chain in chains_of(hits, passage_words)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _CHAIN_TYPES)], names=_CHAIN_NAMES)

    return run


_BLANKS = b" \t\n\r\v\f"
_AROUND = (f"{_CHAIN}, first_tag int, joined boolean, back int, back_words int, back_open boolean, ahead int, ahead_words int, "
           "ahead_open boolean")
_SIDE_TYPES = [pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_()]


def agreeing(a: bytes, b: bytes) -> int:
    """How many bytes a and b have in common from their beginnings on."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _whole_words(a: bytes, b: bytes, most: int) -> int:
    """The largest length up to most at which neither a nor b is inside a word."""
    while most and not ((most == len(a) or a[most] in _BLANKS) and (most == len(b) or b[most] in _BLANKS)):
        most -= 1
    return most


def around(a: bytes, b: bytes, ended: bool) -> tuple[int, int, bool]:
    """What two texts have in common from here on: bytes and number of whole words, and whether more may follow, as it may where
    all bytes agree and the texts have not ended."""
    n = agreeing(a, b)
    part = a[:_whole_words(a, b, n)].rstrip(_BLANKS)
    return len(part), len(part.split()), not ended and n == min(len(a), len(b))


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(*(r[c] for c in [*_CHAIN_NAMES, "first_tag", "joined"]),
                *around(r["before"][::-1], r["first_before"][::-1], r["from_begin"]),
                *around(r["after"], r["first_after"], r["to_end"])) for r in batch.to_pylist()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*_CHAIN_TYPES, *_SIDE_TYPES])],
                                             names=[c.split()[0] for c in _AROUND.split(", ")])


def _beside_texts(chains: DataFrame, texts: DataFrame, reach: int | None) -> DataFrame:
    """Chains whose digest is that of the first place, with reach bytes before and after both (None: all of them), and whether
    the bytes up to the next chain agree as well (joined).

    The texts are cut in the JVM, beside each chain, before they are shuffled again or sent to Python. Both joins read the texts
    with the same columns and key, so Spark shuffles them once; the tag is therefore no join key.
    """
    def sides(prefix: str, start: str) -> list:
        size, begin, n = F.octet_length("data"), F.col(start), F.col("stop") - F.col("start")
        far = F.lit(reach) if reach else size
        before = F.least(begin, far)
        gap = F.greatest(F.col("next_start") - F.col("stop"), F.lit(0))
        return [F.substring("data", begin - before + 1, before).alias(f"{prefix}before"),
                F.substring("data", begin + n + 1, far).alias(f"{prefix}after"),
                F.md5(F.substring("data", begin + 1, n)).alias(f"{prefix}digest"),
                F.when(F.col("next_start").isNotNull(), F.md5(F.substring("data", begin + n + 1, gap))).alias(f"{prefix}gap"),
                (before == begin).alias(f"{prefix}begin"), (begin + n + far >= size).alias(f"{prefix}end")]

    own = texts.select(F.col("doc_id").alias("_own"), F.col("tag").alias("_own_tag"), "data")
    near = chains.join(own, (F.col("doc_id") == F.col("_own")) & (F.col("tag") - F.col("_own_tag") == 0))
    near = near.select(*_CHAIN_NAMES, *sides("", "start"))
    other = texts.select(F.col("doc_id").alias("_other"), F.col("tag").alias("first_tag"), "data")
    both = near.join(other, F.col("first_doc") == F.col("_other")).select(*near.columns, "first_tag", *sides("first_", "first_start"))
    return both.where(F.col("digest") == F.col("first_digest")).select(
        *_CHAIN_NAMES, "first_tag", "before", "first_before", "after", "first_after",
        F.coalesce(F.col("gap") == F.col("first_gap"), F.lit(False)).alias("joined"),
        (F.col("begin") & F.col("first_begin")).alias("from_begin"), (F.col("end") & F.col("first_end")).alias("to_end"))


def extend(chains: DataFrame, texts: DataFrame, reach: int = REACH) -> DataFrame:
    """The chains at their full length: the longest run of whole words that both texts hold at one distance.

    Chains at one distance are joined where the bytes between them agree. reach bytes at either side are compared first; what goes
    on beyond them is compared over the whole texts.
    """
    tried = _beside_texts(chains, texts, reach).mapInArrow(_extended, _AROUND).distinct()
    line = ["doc_id", "tag", "first_doc", "first_tag", "_shift"]
    # A document's chains at one distance: no more than its own chunks.
    order = Window.partitionBy(*line).orderBy("start")
    parted = F.when(F.lag("joined").over(order) & (F.lag("next_start").over(order) == F.col("start")), 0).otherwise(1)
    tried = tried.withColumn("_shift", F.col("first_start") - F.col("start")).withColumn("_run", parted)
    tried = tried.withColumn("_run", F.sum("_run").over(order))
    first, last = (lambda c: F.min_by(c, "start").alias(c)), (lambda c: F.max_by(c, "start").alias(c))
    runs = store(tried.groupBy(*line, "_run").agg(
        F.max("stop").alias("stop"), F.min("word").alias("word"), F.max("stop_word").alias("stop_word"),
        F.min("start").alias("start"), *map(first, ("first_start", "back", "back_words", "back_open")),
        *map(last, ("ahead", "ahead_words", "ahead_open"))), "extended")
    rest = runs.where(F.col("back_open") | F.col("ahead_open"))
    if not rest.isEmpty():
        rest = rest.withColumn("next_start", F.lit(None).cast("int")).select(*_CHAIN_NAMES).distinct()
        runs = runs.where(~F.col("back_open") & ~F.col("ahead_open")).unionByName(
            _beside_texts(rest, texts, None).mapInArrow(_extended, _AROUND), allowMissingColumns=True)
    return runs.select(
        "doc_id", "tag", (F.col("start") - F.col("back")).alias("start"), (F.col("stop") + F.col("ahead")).alias("stop"),
        (F.col("stop_word") - F.col("word") + F.col("back_words") + F.col("ahead_words")).alias("words"), "first_doc",
        (F.col("first_start") - F.col("back")).alias("first_start")).distinct()


def repeated_passages(docs: DataFrame, passage_words: int = PASSAGE_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """doc_id, tag, start, stop, words, first_doc, first_start: passages of at least passage_words words that stand in a
    document with a smaller doc_id, each with the first one's place there.

    Each passage is as long as both texts agree around it, by whole words. Repeats inside one document are not reported. Rows
    equal in doc_id and text are one document. Rows with a null doc_id or text are left out, an empty table gives an empty result.
    """
    pieces = chunk(docs, seed_words)
    # Only digests of two documents go on; the stored sides leave the join two plain exchanges, which Spark can split.
    ends = pieces.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("_last"))
    repeated = store(ends.where(F.col("first_doc") < F.col("_last")).drop("_last"), "repeated")
    shared = store(_unpacked(pieces.join(repeated, "digest")), "shared")
    first = store(shared.where(F.col("doc_id") == F.col("first_doc")).groupBy("digest")
                  .agg(F.min("start").alias("first_start")), "first")
    hits = shared.where(F.col("doc_id") > F.col("first_doc")).join(first, "digest")
    # One document's hits: no more than its own chunks.
    by_doc = hits.select("doc_id", "tag", F.struct("nth", "start", "stop", "word", "stop_word", "first_doc", "first_start").alias("h")) \
        .distinct().groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list("h")).alias("hits"))
    chains = store(by_doc.mapInArrow(_chains(passage_words), _CHAIN), "chains")
    texts = _texts(docs)
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["doc_id", "tag"])
    return extend(chains, texts).where(F.col("words") >= passage_words)


def remove_passages(docs: DataFrame, passages: DataFrame, text: str = "text") -> DataFrame:
    """docs with the reported passages cut out of the text; all rows and columns stay."""
    spans = passages.groupBy(F.col("doc_id").alias("_of_doc"), F.col("tag").alias("_of_tag")).agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_spans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    value = F.col("_row").getField(text).cast("string")
    rows = rows.select("_row", F.col("_row.doc_id").cast("bigint").alias("_of_doc"), F.hash(value).alias("_of_tag"),
                       value.cast("binary").alias("_data")).join(spans, ["_of_doc", "_of_tag"], "left")
    cut_text = F.expr("""aggregate(_spans, named_struct('t', cast('' AS binary), 'at', 0), (s, x) -> named_struct(
        't', IF(x.start > s.at, concat(s.t, substring(_data, s.at + 1, x.start - s.at)), s.t),
        'at', greatest(s.at, x.stop)), s -> cast(concat(s.t, substring(_data, s.at + 1)) AS string))""")
    kept = F.when(F.col("_spans").isNull(), value).otherwise(cut_text)
    return rows.select(*[kept.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])
