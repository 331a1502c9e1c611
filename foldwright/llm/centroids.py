"""Exact k-means on integer vectors by progressive search over Walsh-Hadamard coefficients.

Components are integers (floor of the number times a scale), so every distance, sum and mean is exact and the result does not
depend on how rows are dealt out. The unnormalised transform of 64 components keeps distances up to the factor 64:
||Hx - Hc||^2 = 64 ||x - c||^2, in integers. Coefficients are taken in order of their sign changes (coarse to fine) in groups
of 1, 1, 2, 4, ..., 32. After the first four, the centroid that is nearest so far is finished; its distance is the limit.
The differences of the others are accumulated group by group, and a centroid leaves a vector's search as soon as its sum is
strictly above the limit. What is left has all 64 coefficients, hence its exact distance; ties go to the smaller number.

Tasks assign rows and send only sums per centroid (at most the number of centroids rows a task); the driver holds the
centroids. Equal vectors or a hot cluster therefore cost no more than other rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import store

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Above it, 64 times a squared distance may not fit 64 bits.
MOST = 1 << 24
_STRIP = 1024
_FINISH_AFTER = 4


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of integer rows, unnormalised, coefficients by their number of sign changes."""
    n, dim = x.shape
    x = x.astype(np.int64)
    half = 1
    while half < dim:
        pairs = x.reshape(n, dim // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, dim)
        half *= 2
    return x[:, coarse_to_fine(dim)]


def coarse_to_fine(dim: int) -> np.ndarray:
    """Places of the coefficients in order of sign changes: the bit-reversed Gray code."""
    bits = dim.bit_length() - 1
    gray = np.arange(dim) ^ (np.arange(dim) >> 1)
    return sum((((gray >> b) & 1) << (bits - 1 - b) for b in range(bits)), np.zeros(dim, dtype=int))


def _groups(dim: int) -> list[tuple[int, int]]:
    cuts = [0, 1] + [2 ** i for i in range(1, dim.bit_length())]
    return list(zip(cuts, cuts[1:]))


def _add(total, rows, cols, x, c, lo, hi):
    for i in range(0, len(rows), _STRIP * 8):  # a strip of pairs at a time
        r, k = rows[i:i + _STRIP * 8], cols[i:i + _STRIP * 8]
        apart = x[r, lo:hi] - c[k, lo:hi]
        total[r, k] += np.einsum("ij,ij->i", apart, apart)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance of every integer row."""
    c, dim = transform(centroids), centroids.shape[1]
    number, distance = np.empty(len(vectors), dtype=np.int32), np.empty(len(vectors), dtype=np.int64)
    for begin in range(0, len(vectors), _STRIP):
        x = transform(vectors[begin:begin + _STRIP])
        n = np.arange(len(x))
        total = np.zeros((len(x), len(c)), dtype=np.int64)
        alive = np.ones(total.shape, dtype=bool)
        limit = None
        for lo, hi in _groups(dim):
            rows, cols = np.nonzero(alive)
            _add(total, rows, cols, x, c, lo, hi)
            if limit is None and (hi >= _FINISH_AFTER or hi == dim):
                first = total.argmin(axis=1)
                rest = x[:, hi:] - c[first, hi:]
                limit = total[n, first] + np.einsum("ij,ij->i", rest, rest)
            if limit is not None:
                alive &= total <= limit[:, None]
        best = np.where(alive, total, np.iinfo(np.int64).max).argmin(axis=1)  # the first of equal ones
        number[begin:begin + len(x)], distance[begin:begin + len(x)] = best, total[n, best] // dim
    return number, distance


def _kept(embedding: Column, dim: int) -> Column:
    size = F.size(embedding) == dim
    return F.coalesce(size & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and x (integer components) of the vectors with exactly dim components, none null or non-finite.

    A component whose integer is beyond MOST either way is an error: its distances would not fit 64 bits.
    """
    vector = F.col(f"`{embedding}`").cast("array<double>")
    fits = F.forall("_v", lambda v: F.abs(F.floor(v * float(scale))) <= MOST)
    rows = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), vector.alias("_v")).where(_kept(F.col("_v"), dim))
    too_large = F.raise_error(F.concat(F.lit(f"components above {MOST} / {scale} in vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))
    return rows.select("vec_id", F.when(fits, F.transform("_v", lambda v: F.floor(v * float(scale)).cast("int"))).otherwise(too_large.cast("array<int>")).alias("x"))


def first_centroids(rows: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors whose ids hash smallest, in hash order (a null id as an empty text; equal ids: by components)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = rows.select(h.alias("_h"), "x").orderBy("_h", "x").limit(k).collect()  # k rows
    return np.array([r["x"] for r in chosen], dtype=np.int64)


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _sums(centroids: np.ndarray):
    """Task function: per centroid the number of its rows and the sums of their components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for b in batches:
            x = _matrix(b, dim)
            number, _ = nearest(x, centroids)
            order = np.argsort(number, kind="stable")
            here, begin = np.unique(number[order], return_index=True)
            if len(here):
                total[here] += np.add.reduceat(x[order], begin, axis=0)
            count += np.bincount(number, minlength=k)
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()), "n": pa.array(count[used], pa.int64()),
                                              "s": pa.array(total[used].tolist(), pa.list_(pa.int64()))})

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, distance = nearest(_matrix(b, centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(number), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every non-empty centroid becomes the floor of its rows' mean, in whole numbers of any size."""
    dim = centroids.shape[1]
    parts = rows.select("x").mapInArrow(_sums(centroids), "cluster int, n bigint, s array<bigint>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(j)).cast("decimal(20,0)")).alias(f"s{j}") for j in range(dim)])
    moved = centroids.copy()
    for r in sums.collect():  # one row per centroid
        moved[r["cluster"]] = [int(r[f"s{j}"]) // r["n"] for j in range(dim)]
    return moved


def cluster(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = DIM, scale: int = SCALE,
            k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, a written table, and the final centroids.

    dim is a power of two. Vectors of another length, null ones and ones with null or non-finite components are not kept
    (they have no distance); repeated rows are rows of their own. With fewer than k vectors every one is a centroid; an
    empty table gives an empty result.
    """
    if dim < 1 or dim & (dim - 1):
        raise ValueError("dim must be a power of two")
    table = store(integers(rows, vec_id, embedding, dim, scale), "vectors")
    centroids = first_centroids(table, k, seed)
    id_type = dict(table.dtypes)["vec_id"]
    if not len(centroids):
        return table.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0), centroids.reshape(0, dim)
    for _ in range(rounds):
        centroids = _moved(table, centroids)
    found = table.mapInArrow(_assigned(centroids), f"vec_id {id_type}, cluster int, distance bigint")
    return store(found, "clusters"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add cluster_inertia, inertia and centroid_sha256 (decimal components joined by commas)."""
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()  # one row per centroid
    inertia = {r["cluster"]: r["n"] for r in per}
    table = [(i, inertia.get(i, 0), sum(inertia.values()), d) for i, d in enumerate(digests)]
    facts = found.sparkSession.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def twin_sql(dim: int = DIM, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same by plain distances, every vector against every centroid, for DuckDB."""
    steps = [f"""
kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, x FROM (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * {scale}) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {dim})),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS cluster, x AS c
       FROM kept QUALIFY cluster < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT row, vec_id, x, unnest(min(struct_pack(d := d, cluster := cluster)), max_depth := 2) FROM (
  SELECT row, vec_id, x, cluster, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
  FROM kept, c{i}) GROUP BY row, vec_id, x)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT cluster, j, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
         FROM (SELECT cluster, unnest(x) AS v, unnest(range(1, {dim + 1})) AS j FROM a{i}) GROUP BY cluster, j),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(moved, c) AS c FROM c{i} LEFT JOIN (
  SELECT cluster, list(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END ORDER BY j) AS moved FROM m{i} GROUP BY cluster) USING (cluster))""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""
