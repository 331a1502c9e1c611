"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Exact copies (equal digests of the text) become one node; everything below works on nodes.
2. A shingle's weight is its count in the text times a damped IDF, 1 + DAMPING * ln(1 + N / frequency) / ln(1 + N). A first pass
   counts all shingles in 2**FREQUENCY_BITS hashed cells; a second one counts those of the fullest cells by themselves. So the
   shingles in one document of FREQUENT or more have their true frequency, whatever the corpus's size, and their number
   is bounded by FREQUENT times a document's average; all others count as rare, as if one document held them.
3. Improved consistent weighted sampling gives BANDS * ROWS samples per node: two nodes share a sample with probability equal
   to their weighted Jaccard similarity. ROWS samples make a band; nodes with an equal band are candidates.
4. In every bucket all nodes are compared with one centre (a star, never all pairs), by the weighted Jaccard similarity
   of the whole texts; the plain similarity of the shingle sets counts as well, so that the IDF cannot part the copies of
   a group that makes up much of the corpus. Links make components.
5. Only buckets that still hold several components can hide a link. Their nodes that share a second band form clusters; in a
   cluster the nodes outside its largest component are compared with all others, in pairs of blocks of bounded size.

At similarity 0.8 a pair shares a band with probability 1 - (1 - 0.8**3)**16 > 0.9999, and a second one in 0.9998 of cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import store, text_slices, whole_row
from foldwright.llm.shingles import batches_of, mixed, shingles

BANDS, ROWS = 16, 3
SIMILARITY = 0.8
DAMPING = 0.5
FREQUENCY_BITS = 18
FREQUENT = 64
_SEGMENT = 4096
_SHARED = 20  # of the 48 samples; a pair at 0.8 has as many with probability above 0.9999999
_BLOCK_NODES, _BLOCK_CHARS = 1000, 8_000_000


def _digest():
    return F.unhex(F.md5(F.col("text").cast("string")))


def _key(doc_id: str):
    """A doc_id to join on: null counts as a value."""
    return F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63))).alias("key")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, digest, text of rows with a text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where(F.col("text").isNotNull()).select("doc_id", _digest().alias("digest"), "text")


# --- weights -----------------------------------------------------------------------------------------

def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << FREQUENCY_BITS, dtype=np.int64)
    for batch in batches:
        for _, texts in text_slices(batch, 0):
            distinct = [np.unique(s) for s in shingles(texts)]
            counts += np.bincount(_cells(np.concatenate(distinct)), minlength=len(counts))
    for segment, part in enumerate(counts.reshape(-1, _SEGMENT)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([part.tobytes()], pa.binary())],
                                             names=["segment", "counts"])


def _sum_cells(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, dtype=np.int64) for c in group["counts"])
    return pd.DataFrame({"segment": group["segment"].iloc[:1], "counts": [total.tobytes()]})


def frequencies(texts: DataFrame) -> np.ndarray:
    """How many documents hold a shingle of each cell, over all rows (a column text without nulls): a fixed-size table."""
    parts = texts.select("text").mapInArrow(_count_cells, "segment bigint, counts binary")
    parts = parts.withColumn("salt", F.spark_partition_id() % 64)
    some = parts.groupBy("segment", "salt").applyInPandas(_sum_cells, "segment bigint, counts binary")
    out = np.zeros((1 << FREQUENCY_BITS) // _SEGMENT * _SEGMENT, dtype=np.int64)
    for r in some.groupBy("segment").applyInPandas(_sum_cells, "segment bigint, counts binary").collect():
        at = r["segment"] * _SEGMENT
        out[at:at + _SEGMENT] = np.frombuffer(r["counts"], dtype=np.int64)
    return out


def _count_heavy(sent):
    """Task function: how many documents hold each shingle of a heavy cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch, 0):
                found = np.concatenate([np.unique(s) for s in shingles(texts)])
                shingle, n = np.unique(found[sent.value[_cells(found)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    return run


class Weights:
    """Weights of single shingles: those that many documents hold in a table, one weight for all others."""

    def __init__(self, frequent: np.ndarray, frequency: np.ndarray, n_docs: int):
        order = np.argsort(frequent)
        self.frequent = frequent[order]
        self.weight = self._of(frequency[order], n_docs)
        self.rare = self._of(np.ones(1), n_docs)[0]

    @staticmethod
    def _of(frequency: np.ndarray, n_docs: int) -> np.ndarray:
        return (1 + DAMPING * np.log1p(n_docs / frequency) / np.log1p(max(n_docs, 1))).astype(np.float32)

    def __call__(self, shingle: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.full(len(shingle), self.rare, dtype=np.float32)
        at = np.minimum(np.searchsorted(self.frequent, shingle), len(self.frequent) - 1)
        return np.where(self.frequent[at] == shingle, self.weight[at], self.rare)


def least_frequent(n_docs: int) -> int:
    """In how many documents a frequent shingle stands at least."""
    return max(2, -(-n_docs // FREQUENT))


def shingle_weights(texts: DataFrame, n_docs: int) -> Weights:
    """Weights over all rows (a column text without nulls): two passes, and at most FREQUENT shingles per average one of a row."""
    least = least_frequent(n_docs)
    heavy = texts.sparkSession.sparkContext.broadcast(frequencies(texts) >= least)
    counts = texts.select("text").mapInArrow(_count_heavy(heavy), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= least).toPandas()
    return Weights(rows["shingle"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(float), n_docs)


def weighted(hashes: np.ndarray, idf: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text and their weights."""
    distinct, count = np.unique(hashes, return_counts=True)
    return distinct, count * idf(distinct)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Weighted Jaccard similarity (sum of minima / sum of maxima) and that of the sets; 0 if a text has no word."""
    if not len(a[0]) or not len(b[0]):
        return 0.0, 0.0
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][ia], b[1][ib]).sum())
    return least / (float(a[1].sum()) + float(b[1].sum()) - least), len(ia) / (len(a[0]) + len(b[0]) - len(ia))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    return max(jaccard(a, b))


# --- samples -----------------------------------------------------------------------------------------

def _gamma2_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of n equal parts, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


class Sampler:
    """Improved consistent weighted sampling with r, c ~ Gamma(2, 1) and beta ~ U(0, 1) drawn from tables by hashed bits."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 5):
        self.seeds = mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        r = _gamma2_quantiles(1 << 12)
        self.r, self.inverse_r = r.astype(np.float32), (1 / r).astype(np.float32)
        self.log_c = np.log(_gamma2_quantiles(1 << 16)).astype(np.float32)

    def __call__(self, features: np.ndarray, weights: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """(texts, samples) uint32 for texts whose features start at begins (none empty)."""
        out = np.empty((len(begins), len(self.seeds)), dtype=np.uint32)
        log_w = np.log(weights).astype(np.float32)
        low32 = np.uint64(0xFFFFFFFF)
        with np.errstate(over="ignore"):
            for k, seed in enumerate(self.seeds):
                x = (features ^ seed) * np.uint64(0xD6E8FEB86659FD93)
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
                x ^= x >> np.uint64(32)
                ri = (x & np.uint64(0xFFF)).astype(np.int64)
                beta = ((x >> np.uint64(12)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(65536)
                r = self.r[ri]
                t = np.floor(log_w * self.inverse_r[ri] + beta)
                log_a = self.log_c[((x >> np.uint64(28)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta + 1)
                # Floats as integers of the same order, in the high half; (feature, t) hashed in the low half.
                bits = log_a.view(np.int32)
                key = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) + (1 << 31)
                name = (x ^ (t.astype(np.int64).astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53))) * np.uint64(0x9E3779B97F4A7C15)
                packed = (key.astype(np.uint64) << np.uint64(32)) | (name >> np.uint64(32))
                out[:, k] = np.minimum.reduceat(packed, begins) & low32
        return out


def bands(samples: np.ndarray) -> np.ndarray:
    """(texts, BANDS) int64 from samples."""
    with np.errstate(over="ignore"):
        key = np.repeat(mixed(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :], len(samples), 0)
        for r in range(ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + samples[:, r::ROWS].astype(np.uint64))
    return key.view(np.int64)


def _sampled(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, sampler = sent.value, Sampler()
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                found = [weighted(s, idf) for s in shingles(texts)]
                full = [k for k, f in enumerate(found) if len(f[0])]
                if not full:
                    continue
                sizes = [len(found[k][0]) for k in full]
                samples = sampler(np.concatenate([found[k][0] for k in full]), np.concatenate([found[k][1] for k in full]),
                                  np.cumsum([0, *sizes[:-1]]))
                keep = pa.array(full)
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id").take(keep), rows.column("digest").take(keep),
                    pa.array([list(x) for x in samples.view(np.int32)], pa.list_(pa.int32())),
                    pa.array([list(x) for x in bands(samples)], pa.list_(pa.int64())),
                ], names=["doc_id", "digest", "samples", "bands"])

    return run


# --- links and components ---------------------------------------------------------------------------

def _compared(sent, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, known = sent.value, {}
        for batch in batches:
            a, b, out = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for k in range(batch.num_rows):
                pair = []
                for node, column in ((a[k], "text_a"), (b[k], "text_b")):
                    if node not in known:
                        if len(known) > 200:
                            known.clear()
                        known[node] = weighted(shingles([batch.column(column)[k].as_py()])[0], idf)
                    pair.append(known[node])
                value = similarity(*pair)
                if value >= least:
                    out.append((a[k], b[k], value))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b", "similarity"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, sent, least: float, name: str) -> DataFrame:
    """(a, b, similarity) of the pairs that are similar enough. texts: node, text, a stored table of the nodes needed."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(right, "b").join(left, "a")
    return store(rows.mapInArrow(_compared(sent, least), "a bigint, b bigint, similarity double"), name)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link: root is the least node connected to it.

    Each round takes the least root among the neighbours. Stars, the usual shape, need two rounds; from the third on
    a node also takes its root's own root, so chains halve. Every round is a written table.
    """
    edges = store(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(
        links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "edges")
    state = store(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")).withColumnRenamed("x", "node"), "roots")
    rounds = 0
    while True:
        rounds += 1
        near = edges.join(state.select(F.col("node").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("near"))
        step = state.join(near.withColumnRenamed("x", "node"), "node").select(
            "node", "root", F.least("root", "near").alias("new"))
        if rounds > 2:
            step = store(step, "step")
            jump = step.select(F.col("node").alias("new"), F.col("new").alias("next"))
            step = step.join(jump, "new").select("node", "root", F.least("new", "next").alias("new"))
        state = store(step.select("node", F.col("new").alias("root"), (F.col("new") != F.col("root")).alias("moved")), "roots")
        if state.where("moved").isEmpty():
            return state.select("node", "root")
        state = state.select("node", "root")


class _Members:
    """Nodes of a block, ready to be compared."""

    def __init__(self, rows: pd.DataFrame, idf: np.ndarray):
        self.node, self.root = rows["node"].to_numpy(), rows["root"].to_numpy()
        self.bands, self.samples = (np.array(rows[c].tolist()) for c in ("bands", "samples"))
        self.features = []
        texts = rows["text"].tolist()
        for b, e in batches_of(texts):
            self.features += [weighted(s, idf) for s in shingles(texts[b:e])]
        self.size = np.array([len(f[0]) for f in self.features])
        self.weight = np.array([f[1].sum() for f in self.features])
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.hashes, self.weights = (np.concatenate([f[k] for f in self.features]) for k in (0, 1))

    def like(self, k: int, among: "_Members", least: float) -> list[tuple[int, int, float]]:
        """Links of member k to those of another component that share two bands and enough samples."""
        chosen = np.flatnonzero((among.root != self.root[k]) & ((among.bands == self.bands[k]).sum(1) >= 2)
                                & ((among.samples == self.samples[k]).sum(1) >= _SHARED)
                                & (np.minimum(among.size, self.size[k]) >= (least - 0.2) * np.maximum(among.size, self.size[k])))
        if not len(chosen):
            return []
        hashes, weights = self.features[k]
        at = np.concatenate([np.arange(among.begin[c], among.begin[c + 1]) for c in chosen])
        of = np.repeat(np.arange(len(chosen)), among.size[chosen])
        found = np.minimum(np.searchsorted(hashes, among.hashes[at]), len(hashes) - 1)
        both = np.flatnonzero(hashes[found] == among.hashes[at])
        common = np.bincount(of[both], minlength=len(chosen))
        smaller = np.bincount(of[both], weights=np.minimum(weights[found[both]], among.weights[at[both]]), minlength=len(chosen))
        value = np.maximum(smaller / (self.weight[k] + among.weight[chosen] - smaller),
                           common / (len(hashes) + among.size[chosen] - common))
        return [(int(self.node[k]), int(among.node[c]), float(v)) for c, v in zip(chosen, value) if v >= least]


def _block_links(sent, least: float):
    def compare(minor: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(minor) and len(every):
            one, all_ = _Members(minor, sent.value), _Members(every, sent.value)
            for k in range(len(one.node)):
                out += one.like(k, all_, least)
        return pd.DataFrame(out, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})

    return compare


def _hidden_links(shared: DataFrame, signatures: DataFrame, roots: DataFrame, texts: DataFrame, sent, least: float) -> DataFrame:
    """Links between components that share buckets, which the stars did not compare.

    Nodes of buckets with several components that share two bands form clusters. In a cluster the nodes outside its largest
    component are compared with all others, in pairs of blocks of bounded size; a pair of nodes never leaves the task
    unless it is a link.
    """
    placed = shared.join(roots, "node", "left").select("node", "band", F.coalesce("root", "node").alias("root"))
    parts = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed_buckets = store(parts.where(F.col("low") < F.col("high")).select("band"), "mixed")
    open_nodes = placed.join(mixed_buckets, "band").join(signatures.select("node", "bands"), "node")
    two = F.transform(F.array_remove("bands", F.col("band")), lambda other: F.xxhash64(
        F.least(F.col("band"), other), F.greatest(F.col("band"), other)))
    pairs_of_bands = open_nodes.select("node", F.explode(two).alias("two")).distinct()
    centre = pairs_of_bands.groupBy("two").agg(F.min("node").alias("centre"), F.max("node").alias("last"))
    centre = store(centre.where(F.col("centre") < F.col("last")).drop("last"), "two-bands")
    spokes = store(pairs_of_bands.join(centre, "two").select("node", "centre").distinct(), "spokes")
    # A node ties its centres to the least of them; nodes of one group have the same few centres, so few edges are left.
    hub = spokes.groupBy("node").agg(F.min("centre").alias("hub"))
    ties = spokes.join(hub, "node").select(F.col("hub").alias("a"), F.col("centre").alias("b"))
    edges = ties.unionByName(hub.select(F.col("hub").alias("a"), F.col("node").alias("b"))).where("a <> b").distinct()
    clusters = components(edges).withColumnRenamed("root", "cluster")

    known = clusters.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = store(known.join(texts.select("node", F.length("text").alias("chars")), "node"), "clusters")
    per_root = known.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    facts = per_root.groupBy("cluster").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.sum("chars").alias("chars"),
        F.max("n").alias("n_main"), F.max_by("chars", F.struct("n", "root")).alias("chars_main"))

    def blocks(n, chars):
        return F.greatest(F.ceil(n / _BLOCK_NODES), F.ceil(chars / _BLOCK_CHARS)).cast("int")

    facts = store(facts.where(F.col("n") > F.col("n_main")).select(
        "cluster", "main", blocks(F.col("n"), F.col("chars")).alias("of_all"),
        blocks(F.col("n") - F.col("n_main"), F.col("chars") - F.col("chars_main")).alias("of_minor")), "facts")
    rows = known.drop("chars").join(facts, "cluster").join(signatures, "node")
    place = F.xxhash64("node")
    minor = rows.where(F.col("root") != F.col("main")).withColumn("i", F.pmod(place, F.col("of_minor")).cast("int")).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("of_all") - 1)))
    every = rows.withColumn("j", F.pmod(place, F.col("of_all")).cast("int")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("of_minor") - 1)))
    keep = ["cluster", "i", "j", "node", "root", "samples", "bands", "text"]
    key = ["cluster", "i", "j"]
    left = minor.join(texts, "node").select(*keep)
    right = every.join(texts, "node").select(*[F.col(c).alias(c) for c in keep])  # columns of its own
    found = left.groupBy(*key).cogroup(right.groupBy(*key))
    return store(found.applyInPandas(_block_links(sent, least), "a bigint, b bigint, similarity double"), "hidden-links")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, copy_of, stays, digest for every row: class_id is the least doc_id of the row's group of near
    duplicates, copy_of the least doc_id with exactly its text, stays whether the row is the group's one to keep, digest the
    MD5 of its text.

    Groups are connected components of links of weighted Jaccard similarity `least` or more. A text without words (null,
    empty, marks only) is a duplicate of none but its exact copies; a row with a null text is alone (class_id and copy_of are
    its own doc_id). A null doc_id is never the least unless all in the group are null. Rows that share a doc_id are judged
    by their texts; repeated rows give repeated results.
    """
    spark = docs.sparkSession
    texts = _texts(docs)
    members = store(texts.select("doc_id", "digest"), "members")
    nodes = members.groupBy("digest").agg(F.min("doc_id").alias("first"))
    nodes = store(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # With the first document's id in the key, the copies of a much-copied text fall in many partitions.
    firsts = nodes.select("digest", _key("first"), "node")

    idf = spark.sparkContext.broadcast(shingle_weights(texts, members.count()))
    sampled = texts.mapInArrow(_sampled(idf), "doc_id bigint, digest binary, samples array<int>, bands array<bigint>")
    # One row per node: that of its first document.
    sampled = sampled.withColumn("key", _key("doc_id")).join(firsts, ["digest", "key"])
    signatures = store(sampled.dropDuplicates(["node"]).select("node", "samples", "bands"), "signatures")

    rows = signatures.select("node", F.explode("bands").alias("band"))
    sizes = store(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "buckets")
    shared = store(rows.join(sizes, "band"), "shared")
    # The original of many copies shares more bands with them than they with each other: it makes the best centre.
    hubs = store(shared.groupBy("node").agg(F.sum("n").alias("hub")), "hubs")
    ranked = shared.join(hubs, "node")
    centres = store(ranked.groupBy("band").agg(F.max_by("node", F.struct("hub", -F.col("node"))).alias("centre")), "centres")
    star = shared.join(centres, "band").where(F.col("node") != F.col("centre"))
    star = store(star.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct(), "star")

    wanted = hubs.join(firsts, "node").drop("hub")
    needed = texts.withColumn("key", _key("doc_id")).join(wanted, ["digest", "key"]).select("node", "text")
    needed = store(needed.dropDuplicates(["node"]), "texts")
    links = _links(star, needed, idf, least, "links")
    roots = components(links)
    more = _hidden_links(shared, signatures, roots, needed, idf, least)
    final = components(links.unionByName(more)) if not more.isEmpty() else roots

    order = F.struct(F.col("first").isNull().alias("none"), F.col("first"), F.col("node").alias("rep"))
    classes = nodes.join(final, "node", "left").select("digest", "node", "first", F.coalesce("root", "node").alias("root"))
    classes = store(classes, "classes")
    chosen = store(classes.groupBy("root").agg(F.min(order).alias("least")).select("root", "least.rep", "least.first").select(
        "root", "rep", F.col("first").alias("class_id")), "class-ids")
    of_digest = store(classes.join(chosen, "root").select(
        "digest", "class_id", F.col("first").alias("copy_of"), (F.col("node") == F.col("rep")).alias("chosen")), "of-digest")
    known = members.join(of_digest, "digest").select(
        "doc_id", "class_id", "copy_of", (F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("copy_of"))).alias("stays"), "digest")
    empty = docs.where(F.col("text").isNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"))
    return known.unionByName(empty.select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(True).alias("stays"),
        F.lit(None).cast("binary").alias("digest")))


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs of which one per group of near duplicates is left: that with the least doc_id, once.

    Null texts are no group and stay.
    """
    stays = near_duplicates(docs, least).where("stays").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("_rows"))
    stays = store(stays.where(F.col("digest").isNotNull()), "stays")
    rows = docs.where(F.col("text").isNotNull()).select(whole_row(docs).alias("row"), _digest().alias("digest"), _key("doc_id"))
    rows = rows.join(stays.select("digest", _key("doc_id")), ["digest", "key"])
    if not stays.where(F.col("_rows") > 1).isEmpty():
        rows = rows.dropDuplicates(["digest", "key"])
    return rows.select("row.*").unionByName(docs.where(F.col("text").isNull()))
