import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldwright.operators import ordering
from foldwright.operators.order_stats import order_statistics, quantiles
from foldwright.operators.skew import heavy_keys, lookup


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, many ties in v."""
    rng = np.random.default_rng(3)
    g = np.where(rng.random(2000) < 0.34, 0, rng.integers(1, 40, 2000))
    v = np.round(rng.random(2000), 1)
    rows = [(i, int(g[i]), float(v[i])) for i in range(2000)]
    return spark.createDataFrame(rows, "key bigint, g int, v double").cache(), rows


@pytest.mark.parametrize("chunks", [1, 4, 17])
def test_rank_does_not_depend_on_chunks(skewed, chunks):
    df, rows = skewed
    got = {r["key"]: r["rank"] for r in ordering.rank_rows(
        df.repartition(chunks), [F.desc("v"), F.asc("key")], chunks=chunks).collect()}
    want = {k: i for i, (k, _, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    assert got == want


@pytest.mark.parametrize("few", [True, False])
def test_rank_in_groups(skewed, few):
    df, rows = skewed
    got = {r["key"]: r["rank"] for r in ordering.rank_rows(
        df, [F.asc("v"), F.asc("key")], ["g"], few_groups=few, chunks=7).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))):
            want[r[0]] = i
    assert got == want


def test_hot_group_is_spread(skewed):
    df, _ = skewed
    chunks = ordering.ordered_chunks(df, [F.asc("v"), F.asc("key")], ["g"], 8)
    assert chunks.where("g = 0").select("_chunk").distinct().count() >= 2


def test_running_max(skewed):
    df, rows = skewed
    order = [F.asc("key")]
    chunks = ordering.ordered_chunks(df, order, ["g"], 9)
    got = {r["key"]: r["m"] for r in ordering.running_max(chunks, order, ["g"], F.col("v"), "m").collect()}
    top, want = {}, {}
    for k, g, v in rows:
        want[k] = top.get(g)
        top[g] = max(v, top.get(g, v))
    assert got == want


def test_shuffle_place_is_a_permutation(skewed):
    df, rows = skewed
    placed = ordering.place_in_shuffle(df, "g", "key", 42).collect()
    by_group = {}
    for r in placed:
        by_group.setdefault(r["g"], []).append(r["_before"])
        assert r["_total"] == sum(1 for x in rows if x[1] == r["g"])
    assert all(sorted(v) == list(range(len(v))) for v in by_group.values())


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, 0.5])), min_size=1, max_size=60))
def test_quantiles_are_numpys(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    qs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = quantiles(df, {"v": qs})
    for q in qs:
        assert got[("v", q)] == np.percentile(xs, q * 100)


def test_quantiles_of_many_rows(spark):
    rng = np.random.default_rng(5)
    a, b = rng.beta(8, 1, 30000), np.round(rng.random(30000), 2)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = quantiles(df, {"a": [0.05, 0.5], "b": [0.95]})
    assert got[("a", 0.05)] == np.percentile(a, 5) and got[("a", 0.5)] == np.percentile(a, 50)
    assert got[("b", 0.95)] == np.percentile(b, 95)


def test_group_ranks(skewed):
    df, rows = skewed
    want = {0: [0, 5, 300], 3: [2]}
    got = order_statistics(df, "v", want, by=F.col("g"))
    for g, rs in want.items():
        line = sorted(r[2] for r in rows if r[1] == g)
        assert [got[(g, r)] for r in rs] == [line[r] for r in rs]


def test_bad_input(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    with pytest.raises(ValueError):
        quantiles(df, {"v": [0.5]})
    with pytest.raises(ValueError):
        order_statistics(df.where("v = 1"), "v", {0: [1]})
    assert quantiles(df.where("v = 7"), {"v": [0.5]}) == {("v", 0.5): None}


def test_lookup_with_heavy_keys(skewed, spark):
    df, rows = skewed
    table = spark.createDataFrame([(g, f"name{g}") for g in range(0, 40, 2)], "g int, name string")
    assert heavy_keys(df, ["g"], least=300) == [(0,)]
    df = df.unionByName(spark.createDataFrame([(-1, None, 0.0)], "key bigint, g int, v double"))
    got = {r["key"]: r["name"] for r in lookup(df, table, "g", least=300).collect()}
    assert got == {**{k: (f"name{g}" if g % 2 == 0 else None) for k, g, _ in rows}, -1: None}
    two = df.withColumn("h", F.col("g") * 2)
    pair = lookup(two, table.withColumn("h", F.col("g") * 2), ["g", "h"], least=300)
    assert {r["key"]: r["name"] for r in pair.collect()} == got
