"""Clustering by progressive search against plain distances."""

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldwright.llm import centroids
from llm_cases import SF, needs_data


def test_transform_counts_sign_changes_and_keeps_distances():
    rows = centroids.transform(np.eye(64, dtype=np.int64)).T
    assert [int((np.diff(r) != 0).sum()) for r in rows] == list(range(64))
    x = np.random.default_rng(1).integers(-9999, 9999, (50, 64))
    assert ((centroids.transform(x) ** 2).sum(1) == 64 * (x ** 2).sum(1)).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2 ** 32 - 1), st.sampled_from([1, 2, 8, 64]), st.integers(1, 50), st.sampled_from([1, 3, 300, centroids.MOST]))
def test_nearest_is_exact_with_ties(seed, dim, k, size):
    draw = np.random.default_rng(seed)
    x, c = draw.integers(-size, size + 1, (60, dim)), draw.integers(-size, size + 1, (k, dim))
    number, distance = centroids.nearest(x, c)
    all_pairs = ((x[:, None].astype(object) - c[None]) ** 2).sum(axis=2)
    assert number.tolist() == [int(np.argmin(r)) for r in all_pairs]
    assert distance.tolist() == [min(r) for r in all_pairs.tolist()]


def plain(rows, k, rounds, dim=64):
    """(vec_id, vector) -> rows of the query by Python integers."""
    kept = [(i, tuple(int(np.floor(float(v) * 256)) for v in x)) for i, x in rows
            if x is not None and len(x) == dim and all(v is not None and np.isfinite(v) for v in x)]
    c = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))][:k]

    def assign():
        out = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, centre)) for centre in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        of = assign()
        for j in range(len(c)):
            mine = [x for (_, x), (n, _) in zip(kept, of) if n == j]
            if mine:
                c[j] = tuple(sum(column) // len(mine) for column in zip(*mine))
    of = assign()
    return sorted(((i, n, d, sum(e for m, e in of if m == n), sum(e for _, e in of),
                    hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (n, d) in zip(kept, of)), key=str)


def test_edges_against_plain_integers(spark):
    draw = np.random.default_rng(2)
    rows = [(int(i), [float(v) for v in draw.normal(0, 1, 64)]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [0.0] * 63), (105, [float("nan")] + [0.0] * 63),
             (106, [float("-inf")] + [0.0] * 63), (None, [0.25] * 64), (7, [0.5] * 64), (7, [0.5] * 64)] + [(200 + i, [0.125] * 64) for i in range(40)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, cluster int, x string").repartition(3)
    got = centroids.with_inertia(*centroids.cluster(df, k=7, rounds=3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 7, 3)
    few = df.where("vec_id in (1, 2, 102)")
    assert sorted((tuple(r) for r in centroids.with_inertia(*centroids.cluster(few)).collect()), key=str) == plain([r for r in rows if r[0] in (1, 2)], 40, 5)
    assert centroids.with_inertia(*centroids.cluster(df.limit(0))).collect() == []


def test_components_too_large_for_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9] + [0.0] * 63)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="components above"):
        centroids.cluster(df)
    with pytest.raises(ValueError):
        centroids.cluster(df, dim=48)


@needs_data
def test_twin_gives_the_same_rows(spark):
    got = centroids.with_inertia(*centroids.cluster(spark.read.parquet(f"{SF}/embeddings.parquet"))).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(centroids.twin_sql()).fetchall())
