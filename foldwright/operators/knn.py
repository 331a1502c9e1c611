"""Exact cosine k-nearest-neighbour join and the vote built on it.

Train rows are cut into cells around a bounded number of pivots. The triangle inequality tells
each query which cells can hold one of its k nearest rows; only those are searched, so results
are exact while clustered data need few cells. Queries in order of their cell and train rows in
order of theirs are cut into packs of bounded size. A task keeps the k best rows of a few packs
of queries and reads the packs of train rows one after the other from the checkpoint folder, so
no vector is copied for a shuffle and memory does not grow with the tables. Of a train pack only
the cells that some query may need are multiplied, in single precision; what can be among the k
nearest is measured anew in double precision. Of identical train vectors only the first k keys
can ever win, so copies cannot make a hot cell.

Packs are the second place beside operators/passes.py where RDDs are used: pairs of partitions
are met without a shuffle, and a task sees its pairs one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foldwright.functions.probs import add_up
from foldwright.operators.skew import lookup
from foldwright.operators.splits import seeded_sample
from foldwright.session import freeze

BLOCK_ROWS = 8192
MAX_PIVOTS = 4096
_STRIP = 512
#: Entries of vectors in a pack; of a table of distances to all pivots.
PACK_ENTRIES, _PIVOT_ENTRIES = 1 << 18, 1 << 19
_SALTS = 32
_ZERO = 1e-12
_SLACK = 1e-5
_APART = np.sqrt(2.0)  # unit-vector distance that stands for cosine distance 1


def _unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which rows were the zero vector."""
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n), n[:, 0] == 0


def _apart(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Straight-line distance of unit vectors, the square root of twice the cosine distance."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (units @ pivots.T), 0.0))


def _choose_pivots(train: DataFrame, n: int) -> np.ndarray:
    rows = seeded_sample(train.select("key", "vec"), min(n, MAX_PIVOTS)).collect()  # at most MAX_PIVOTS vectors
    m, zero = _unit(pd.Series([r["vec"] for r in rows]))
    return np.unique(m[~zero], axis=0)


def _into_cells(pivots: np.ndarray):
    """Task function: add the nearest pivot's number and distance; zero vectors get a cell of their own."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            units, zero = _unit(b["t_vec"])
            cell = np.full(len(b), len(pivots), dtype=np.int32)
            away = np.zeros(len(b))
            step = max(1, _PIVOT_ENTRIES // max(len(pivots), 1))
            for lo in range(0, len(b) if len(pivots) else 0, step):
                d = _apart(units[lo:lo + step], pivots)
                cell[lo:lo + step], away[lo:lo + step] = d.argmin(axis=1), d.min(axis=1)
            cell[zero], away[zero] = len(pivots), 0.0
            yield b.assign(cell=cell, away=away)

    return run


def blocks_of(need: np.ndarray, first: np.ndarray, parts: np.ndarray) -> list[np.ndarray]:
    """Per query the numbers of the train blocks of the cells it needs. need: queries x cells."""
    row, cell = np.nonzero(need)
    n = parts[cell]
    begin = np.concatenate([[0], np.cumsum(n)])
    block = np.repeat(first[cell] - begin[:-1], n) + np.arange(begin[-1])
    asked = np.unique(np.stack([np.repeat(row, n), block]), axis=1)  # small cells may share a block
    each = np.bincount(asked[0], minlength=len(need))
    return np.split(asked[1].astype(np.int32), np.cumsum(each)[:-1])


def usable_rows(counts: dict[int, np.ndarray], exclude_same_fold: bool) -> tuple[np.ndarray, dict]:
    """Rows per cell, and those that a query of each fold may use (key None: any other fold). counts[fold][cell]."""
    total = sum(counts.values())
    usable = {f: total - n for f, n in counts.items()} if exclude_same_fold else {}
    return total, usable | {None: total}


def _cells_needed(pivots: np.ndarray, radius: np.ndarray, rows_by_fold: dict[int, np.ndarray], k: int,
                  first: np.ndarray | None = None, parts: np.ndarray | None = None):
    """Task function: add each query's own cell (home) and the distance from it that holds k usable rows for sure (bound).

    With first and parts: instead of the bound the train blocks that may hold its k nearest rows.
    rows_by_fold[f][c]: rows of cell c a query of fold f may use; key None for any other fold.
    """
    def enough(high, may_use):
        """The least distance within which cells with k usable rows end."""
        few = min(64, high.shape[1])  # the nearest cells, which nearly always suffice
        order = np.argpartition(high, few - 1, axis=1)[:, :few] if few < high.shape[1] else np.argsort(high, axis=1)
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(high, order, axis=1), axis=1), axis=1)
        reached = np.take_along_axis(may_use, order, axis=1).cumsum(axis=1) >= k
        rows, found = np.arange(len(high)), reached.any(axis=1)
        bound = np.where(found, high[rows, order[rows, reached.argmax(axis=1)]], np.inf)
        for i in np.flatnonzero(~found) if few < high.shape[1] else []:
            order = np.argsort(high[i])
            if (at := np.flatnonzero(may_use[i][order].cumsum() >= k)).size:
                bound[i] = high[i, order[at[0]]]
        return bound

    def reach(units, zero, may_use):
        d = _apart(units, pivots)
        low, high = d - radius[:-1], d + radius[:-1]
        edge = np.full((len(units), 1), _APART)  # distance to zero vectors
        low, high = np.hstack([low, edge]), np.hstack([high, edge])
        low[zero], high[zero] = _APART, _APART
        bound = enough(high, may_use)
        home = d.argmin(axis=1) if len(pivots) else np.zeros(len(units), dtype=int)
        need = (low <= bound[:, None] + _SLACK) & (may_use > 0)
        return np.where(zero, len(pivots), home), bound, need

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, min(_STRIP, _PIVOT_ENTRIES // (len(pivots) + 1)))
        for b in batches:
            if b.empty:
                continue
            units, zero = _unit(b["q_vec"])
            may_use = [rows_by_fold.get(f, rows_by_fold[None]) for f in b["q_fold"]]
            home, bounds, blocks = [], [], []
            for lo in range(0, len(b), step):
                here, bound, need = reach(units[lo:lo + step], zero[lo:lo + step], np.array(may_use[lo:lo + step]))
                home.append(here)
                bounds.append(bound)
                if first is not None:
                    blocks += blocks_of(need, first, parts)
            out = b.assign(home=np.concatenate(home).astype(np.int32))
            yield out.assign(bound=np.concatenate(bounds)) if first is None else out.assign(blocks=blocks)

    return run


def _block_topk(k: int):
    cols = ["q_key", "t_key", "t_label", "dist"]

    def best(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({c: [] for c in cols})
        t = t.sort_values("t_key", kind="stable")
        tm, labels, folds = _unit(t["t_vec"])[0].T, t["t_label"].to_numpy(), t["t_fold"].to_numpy()
        keys, out = t["t_key"].to_numpy(), []
        qm, qk, qf = _unit(q["q_vec"])[0], q["q_key"].to_numpy(), q["q_fold"].to_numpy()
        for lo in range(0, len(qk), _STRIP):  # a strip of queries at a time bounds the score matrix
            d = np.clip(1.0 - qm[lo:lo + _STRIP] @ tm, 0.0, 2.0)
            d[d < _ZERO] = 0.0
            d[qf[lo:lo + _STRIP, None] == folds[None, :]] = np.inf
            # Stable order: equal distances are won by the smaller train key.
            idx = np.argsort(d, axis=1, kind="stable")[:, :k]
            dist = np.take_along_axis(d, idx, axis=1)
            rows, ranks = np.nonzero(np.isfinite(dist))
            pick = idx[rows, ranks]
            out.append(pd.DataFrame({"q_key": qk[lo:lo + _STRIP][rows], "t_key": keys[pick],
                                     "t_label": labels[pick], "dist": dist[rows, ranks]}))
        return pd.concat(out)

    return best


def own_blocks(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every cell, each cell cut into as many blocks of about `size` rows as it needs."""
    parts = -(-counts // size)
    return np.concatenate([[0], np.cumsum(parts)[:-1]]).astype(np.int64), parts


def _split(rows: DataFrame, cell: str, key: str, first: np.ndarray, parts: np.ndarray, name: str) -> DataFrame:
    """Number blocks: the rows of a cell are dealt by key hash over its blocks."""
    table = pd.DataFrame({cell: np.arange(len(first), dtype=np.int32), "_first": first.astype(np.int32),
                          "_parts": np.maximum(parts, 1).astype(np.int32)})  # at most MAX_PIVOTS + 1 rows
    at = F.col("_first") + F.pmod(F.xxhash64(F.col(key)), F.col("_parts")).cast("int")
    out = rows.join(F.broadcast(rows.sparkSession.createDataFrame(table)), cell)
    return out.withColumn(name, at).drop("_first", "_parts")


def _query_block(n: int, block_rows: int, spark) -> int:
    """Queries per block: enough blocks to use every core, none above block_rows."""
    return int(min(block_rows, max(-(-n // spark.sparkContext.defaultParallelism), 256)))


def _one_block(q: DataFrame, t: DataFrame, k: int, schema: str) -> DataFrame:
    """At most block_rows train rows: they are sent to every task, and no row is shuffled."""
    best, rows = _block_topk(k), q.sparkSession.sparkContext.broadcast(t.toPandas())

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield best(b, rows.value)

    return q.mapInPandas(search, schema)


def pair_blocks(q: DataFrame, t: DataFrame, total: np.ndarray, block_rows: int, deal=own_blocks) -> tuple[DataFrame, DataFrame]:
    """Queries (home, blocks) and train rows (cell): q with (qb, tb), and t copied for every (for_qb, in_tb) that asks.

    deal(rows per cell, block size) gives every cell's first block and number of blocks; total: train rows per cell.
    """
    t = _split(t, "cell", "t_key", *deal(total, block_rows), "in_tb")
    at_home = np.zeros(len(total), dtype=np.int64)
    for r in q.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per cell
        at_home[r["home"]] = r["n"]
    size = _query_block(int(at_home.sum()), block_rows, q.sparkSession)
    q = _split(q, "home", "q_key", *deal(at_home, size), "qb").drop("home").withColumn("tb", F.explode("blocks")).drop("blocks")
    pairs = q.select(F.col("qb").alias("for_qb"), F.col("tb").alias("in_tb")).distinct()  # one per matrix product
    # A block that all queries need is copied by _SALTS tasks, each with its share of the block's rows.
    pairs = pairs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    t = t.withColumn("_salt", F.pmod(F.xxhash64("t_key"), F.lit(_SALTS)).cast("int"))
    return q, t.join(pairs, ["in_tb", "_salt"]).drop("_salt")


def _written(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _packs(rows: DataFrame, by: list[str], vec: str, n: int, least: int) -> RDD:
    """Packs of the n rows in the order `by`, each a number and a written batch of at most PACK_ENTRIES entries of vectors.

    There are `least` partitions at least where the rows allow it.
    """
    dim = rows.agg(F.max(F.size(vec))).first()[0] or 1
    most = max(1, PACK_ENTRIES // max(dim, 1))
    parts = max(1, -(-n * 5 // (most * 4)), min(least, -(-n // 256)))  # ranges differ in size: most of them are one pack

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            each = -(-whole.num_rows // max(1, -(-whole.num_rows // most)))
            for lo in range(0, whole.num_rows, each or 1):
                yield pa.RecordBatch.from_arrays([pa.array([_written(whole.slice(lo, each))], pa.binary())], ["pack"])

    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(cut, "pack binary")
    return dealt.rdd.map(lambda row: bytes(row["pack"])).zipWithUniqueId().map(lambda p: (p[1], p[0]))


def _read(pack: bytes) -> pa.Table:
    return pa.ipc.open_stream(pack).read_all()


def _vectors(column: pa.ChunkedArray, n: int) -> np.ndarray:
    units, _ = _unit(pd.Series(list(column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1))))
    return units


def _plain(column: pa.ChunkedArray) -> np.ndarray:
    """Keys as numbers where they are whole numbers, else as objects."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    out = np.empty(len(column), dtype=object)
    out[:] = column.to_pylist()
    return out


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Numbers in the order of the keys, nulls first."""
    if keys.dtype != object:
        return keys
    place = {key: i for i, key in enumerate(sorted(set(keys), key=lambda key: (key is not None, key)))}
    return np.array([place[key] for key in keys], dtype=np.int64)


class _Nearest:
    """The k best train rows seen so far of every query of a pack."""

    def __init__(self, pack: bytes, k: int):
        rows = _read(pack)
        self.keys, self.k, n = rows["q_key"], k, rows.num_rows
        self.units = _vectors(rows["q_vec"], n)
        self.single, self.fold = self.units.astype(np.float32), rows["q_fold"].to_numpy()
        self.bound = rows["bound"].to_numpy() ** 2 / 2  # cosine distance
        self.dist = np.full((n, k), np.inf)
        self.label = np.zeros((n, k))
        self.key: np.ndarray | None = None

    def meet(self, pack: bytes, pivots: np.ndarray, radius: np.ndarray) -> None:
        """Search a pack of train rows, a strip of queries at a time."""
        rows = _read(pack)
        units, keys, labels = _vectors(rows["t_vec"], rows.num_rows), _plain(rows["t_key"]), rows["t_label"].to_pandas().to_numpy(dtype=float)
        fold, cell = rows["t_fold"].to_numpy(), rows["cell"].to_numpy()
        if self.key is None:
            self.key = np.zeros(self.dist.shape, dtype=keys.dtype)
        elif keys.dtype == object:
            self.key = self.key.astype(object)
        single = units.astype(np.float32)
        slack = (units.shape[1] + 8) * 1.2e-7  # of a sum of products in single precision
        cells, place = np.unique(cell, return_inverse=True)
        outside = cells == len(pivots)  # zero vectors
        mid = pivots[np.where(outside, 0, cells)] if len(pivots) else np.zeros((len(cells), units.shape[1]))
        for lo in range(0, len(self.dist), _STRIP):
            q = slice(lo, lo + _STRIP)
            bound = np.minimum(self.bound[q], self.dist[q, -1])
            low = _apart(self.units[q], mid) - radius[cells]
            low[:, outside] = _APART
            low[~self.units[q].any(axis=1)] = _APART
            need = low <= np.sqrt(2.0 * bound)[:, None] + _SLACK
            if not need.any():
                continue
            mine, here = np.flatnonzero(need.any(axis=1)), np.flatnonzero(need.any(axis=0)[place])
            t = single if len(here) == len(single) else single[here]
            near = (self.single[q] if len(mine) == len(bound) else self.single[q][mine]) @ t.T
            least = (1.0 - bound[mine] - slack - _ZERO).astype(np.float32)
            near_enough = near >= least[:, None]
            many = np.flatnonzero(np.count_nonzero(near_enough, axis=1) > 8 * self.k)
            if many.size and near.shape[1] > self.k:  # the k nearest of this pack are a bound as well
                own = near[many]
                own[self.fold[q][mine[many]][:, None] == fold[here][None, :]] = -np.inf
                kth = -np.partition(-own, self.k - 1, axis=1)[:, self.k - 1]
                near_enough[many] &= own >= (kth - 2 * slack)[:, None]
            row, col = np.nonzero(near_enough)
            row, col = mine[row] + lo, here[col]
            keep = self.fold[row] != fold[col]
            self._add(row[keep], col[keep], units, keys, labels)

    def _add(self, row: np.ndarray, col: np.ndarray, units: np.ndarray, keys: np.ndarray, labels: np.ndarray) -> None:
        if not len(row):
            return
        d = np.empty(len(row))
        for lo in range(0, len(row), 1 << 14):  # a pair's distance does not depend on the pairs beside it
            some = slice(lo, lo + (1 << 14))
            d[some] = 1.0 - np.einsum("ij,ij->i", self.units[row[some]], units[col[some]])
        d = np.clip(d, 0.0, 2.0)
        d[d < _ZERO] = 0.0
        keep = d <= self.dist[row, -1]
        row, col, d = row[keep], col[keep], d[keep]
        touched = np.unique(row)
        old_row, old = np.repeat(touched, self.k), self.dist[touched].ravel()
        known = np.isfinite(old)
        row = np.concatenate([old_row[known], row])
        d = np.concatenate([old[known], d])
        key = np.concatenate([self.key[touched].ravel()[known], keys[col]])
        label = np.concatenate([self.label[touched].ravel()[known], labels[col]])
        order = np.lexsort((_ranks(key), d, row))  # equal distances are won by the smaller train key
        row, d, key, label = row[order], d[order], key[order], label[order]
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, dtype=int)
        rank = np.arange(len(row)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(row)]])))
        best = rank < self.k
        at = row[best], rank[best]
        self.dist[at], self.key[at], self.label[at] = d[best], key[best], label[best]

    def found(self, schema: pa.Schema) -> bytes:
        row, rank = np.nonzero(np.isfinite(self.dist))
        key = self.key[row, rank] if self.key is not None else np.zeros(0, dtype=object)
        label = self.label[row, rank]
        columns = [self.keys.combine_chunks().take(pa.array(row)), pa.array(key if key.dtype != object else key.tolist(), schema.field("t_key").type),
                   pa.array(label, mask=np.isnan(label)).cast(pa.int32()), pa.array(self.dist[row, rank])]
        return _written(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema.names))


def _packed_pairs(q: DataFrame, t: DataFrame, pivots: np.ndarray, k: int, exclude_same_fold: bool, schema: str) -> DataFrame:
    """The k nearest rows of every query among the train rows of a partition of packs; those of all partitions are still to be merged."""
    spark = q.sparkSession
    sc = spark.sparkContext
    t = freeze(t.mapInPandas(_into_cells(pivots), _schema(t, "cell int, away double")))
    n_cells = len(pivots) + 1
    radius, by_fold = np.zeros(n_cells), {}
    for r in t.groupBy("cell", "t_fold").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("far")).collect():
        by_fold.setdefault(r["t_fold"], np.zeros(n_cells, dtype=np.int64))[r["cell"]] = r["n"]
        radius[r["cell"]] = max(radius[r["cell"]], r["far"])
    total, usable = usable_rows({None: np.zeros(n_cells, dtype=np.int64)} | by_fold, exclude_same_fold)
    q = freeze(q.mapInPandas(_cells_needed(pivots, radius, usable, k), _schema(q, "home int, bound double")))
    tasks = 4 * sc.defaultParallelism
    queries = _packs(q, ["home", "q_key"], "q_vec", q.count(), tasks)
    packs = _packs(t.select("t_key", "t_vec", "t_fold", "t_label", "cell"), ["cell", "t_key"], "t_vec", int(total.sum()), 1)
    packs.persist(StorageLevel.MEMORY_AND_DISK)
    packs.checkpoint()  # from then on a task reads them from the shared folder, as a stream
    packs.count()
    packs.unpersist()
    # Where the queries make a task for every core, each reads all train packs.
    packs = packs.coalesce(max(1, tasks // (2 * queries.getNumPartitions())))
    sent = sc.broadcast((pivots, radius))
    empty = spark.createDataFrame([], schema)
    arrow = to_arrow_schema(empty.schema)

    def search(pairs):
        states: dict = {}
        for (name, mine), (_, theirs) in pairs:
            if name not in states:
                states[name] = _Nearest(mine, k)
            states[name].meet(theirs, *sent.value)
        for state in states.values():
            yield (state.found(arrow),)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack in b.column("found"):
                yield from _read(pack.as_py()).to_batches(max_chunksize=10_000)

    found = spark.createDataFrame(queries.cartesian(packs).mapPartitions(search), "found binary")
    return found.mapInArrow(rows, empty.schema)


def few_copies(t: DataFrame, k: int) -> DataFrame:
    """Of identical train vectors (of one fold) the k smallest keys: others are never among k nearest rows."""
    copies = Window.partitionBy("t_vec", "t_fold").orderBy("t_key")
    return t.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy")


def knn_join(query: DataFrame, train: DataFrame, k: int = 15, block_rows: int = BLOCK_ROWS,
             exclude_same_fold: bool = False) -> DataFrame:
    """(q_key, t_key, t_label, dist): the k nearest train rows of each query by cosine distance.

    Train rows that fit one block of block_rows rows are broadcast; more are cut into cells of about that many rows (at most
    MAX_PIVOTS cells). Both plans are exact; vectors without clusters need all pairs then (operators/ann.py searches them
    approximately).

    query needs key and vec (and fold); train needs key, vec, label (and fold). With
    exclude_same_fold a query never sees train rows of its own fold: out-of-fold in one job.
    Distances below 1e-12 count as 0; equal distances are won by the smaller key.
    """
    fold = F.col("fold").cast("int")
    t = train.select(F.col("key").alias("t_key"), F.col("vec").alias("t_vec"),
                     (fold if exclude_same_fold else F.lit(-2)).alias("t_fold"),
                     F.col("label").cast("int").alias("t_label"))
    t = few_copies(t, k)
    q = query.select(F.col("key").alias("q_key"), F.col("vec").alias("q_vec"),
                     (fold if exclude_same_fold else F.lit(-1)).alias("q_fold"))
    n_train = train.count()
    schema = f"q_key {dict(q.dtypes)['q_key']}, t_key {dict(t.dtypes)['t_key']}, t_label int, dist double"
    if n_train <= block_rows:
        return _one_block(q, t, k, schema)
    pivots = _choose_pivots(train, -(-n_train // block_rows))
    near = _packed_pairs(q, t, pivots, k, exclude_same_fold, schema)
    w = Window.partitionBy("q_key").orderBy("dist", "t_key")
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"{c} {kind}" for c, kind in df.dtypes) + ", " + more


def vote(neighbours: DataFrame, n_classes: int) -> DataFrame:
    """(key, probs): votes weighted by 1/distance; when there are exact hits only they vote."""
    zero = F.col("dist") == 0
    near = [F.coalesce(F.sum(F.when((F.col("t_label") == c) & ~zero, 1 / F.nullif("dist", F.lit(0.0)))),
                       F.lit(0.0)).alias(f"w{c}") for c in range(n_classes)]
    exact = [F.count_if((F.col("t_label") == c) & zero).cast("double").alias(f"z{c}") for c in range(n_classes)]
    sums = neighbours.groupBy(F.col("q_key").alias("key")).agg(*near, *exact)
    hits = add_up([F.col(f"z{c}") for c in range(n_classes)])
    whole = add_up([F.col(f"w{c}") for c in range(n_classes)])
    probs = F.when(hits > 0, F.array(*[F.try_divide(F.col(f"z{c}"), hits) for c in range(n_classes)])).otherwise(
        F.array(*[F.try_divide(F.col(f"w{c}"), whole) for c in range(n_classes)]))
    return sums.select("key", probs.alias("probs"))


def _knn_probs(query: DataFrame, train: DataFrame, n_classes: int, k: int, block_rows: int,
               exclude_same_fold: bool, recall: float | None = None) -> DataFrame:
    """query with probs. Equal vectors (of one fold) get equal answers, so each is searched once."""
    same = ["vec", "fold"] if exclude_same_fold else ["vec"]
    ident = F.concat_ws("-", F.xxhash64(F.lit(1), *same), F.xxhash64(F.lit(2), *same))  # 128 bits
    rows = query.withColumn("_same", ident)
    one = freeze(rows.groupBy("_same").agg(F.min("key").alias("key"), *[F.min_by(c, "key").alias(c) for c in same]))
    if recall is None:
        near = knn_join(one, train, k, block_rows, exclude_same_fold)
    else:
        from foldwright.operators import ann  # it builds on this module
        near = ann.ann_join(one, train, k, recall, exclude_same_fold, block_rows)
    probs = vote(near, n_classes)
    answers = freeze(one.select("key", "_same").join(probs, "key").drop("key"))
    # Without any usable train row there is no answer, and the row is left out as in knn_join.
    return lookup(rows, answers, "_same").where(F.col("probs").isNotNull()).drop("_same")


def knn_oof(df: DataFrame, n_classes: int, k: int = 15, block_rows: int = BLOCK_ROWS, recall: float | None = None) -> DataFrame:
    """(key, fold, label, probs) for every row, from neighbours in the other folds; recall: as in ann_join, else exact."""
    return _knn_probs(df, df, n_classes, k, block_rows, True, recall).select("key", "fold", "label", "probs")


def knn_predict(train: DataFrame, test: DataFrame, n_classes: int, k: int = 15,
                block_rows: int = BLOCK_ROWS, recall: float | None = None) -> DataFrame:
    """(key, probs) for the test rows; recall: as in ann_join, else exact."""
    return _knn_probs(test.select("key", "vec"), train, n_classes, k, block_rows, False, recall).select("key", "probs")
