"""Fits of all folds at once against plain numpy runs of the same algorithms."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_knn import vec_rows

from foldwright.operators import heads, linear, neural, passes, trees


def drawn(n=240, d=5, k=3, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    return rng.normal(0, 1.2, (k, d))[y] + rng.normal(size=(n, d)), y, np.arange(n) % 4


@pytest.fixture(scope="module")
def data(spark):
    x, y, fold = drawn()
    return vec_rows(spark, x, y, fold), x, y, fold


# --- passes ---------------------------------------------------------------------------------------

def test_blocks_hold_every_row_once_in_any_layout(data):
    df, x, y, fold = data
    packed = passes.pack(df.repartition(7), tasks=3)
    n, total = passes.summed(packed.blocks, lambda b, s: (len(b.y), b.x.sum(axis=0)))
    assert n == len(y) and np.allclose(total, x.sum(axis=0)) and packed.blocks.getNumPartitions() == 3
    again = passes.pack(df.repartition(2), tasks=3)
    for a, b in zip(packed.blocks.collect(), again.blocks.collect()):
        assert (a.x == b.x).all() and (a.y == b.y).all()
    assert packed.class_counts(1, 3).tolist() == np.bincount(y[fold != 1], minlength=3).tolist()


def test_uneven_vectors_and_no_rows_are_errors(spark, data):
    with pytest.raises(ValueError):
        passes.pack(data[0].limit(0))
    odd = spark.createDataFrame([(1, 0, 0, [1.0]), (2, 0, 1, [1.0, 2.0])], "key bigint, fold int, label int, vec array<double>")
    with pytest.raises(Exception, match="components"):
        passes.pack(odd).blocks.count()


# --- linear ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("limit", [linear.NEWTON, 0])
def test_every_fold_reaches_its_own_optimum(data, monkeypatch, limit):
    """Both kinds of steps: the gradient of the weighted, penalised loss vanishes for each fold's rows."""
    df, x, y, fold = data
    monkeypatch.setattr(linear, "NEWTON", limit)
    found = linear.fit(passes.pack(df, tasks=2), [0, 1, 2, 3, None], 3, True)
    for m, (w, _) in found.items():
        rows = np.ones(len(y), dtype=bool) if m is None else fold != m
        xs, ys = x[rows], y[rows]
        weight = len(ys) / (3 * np.bincount(ys, minlength=3))[ys]
        p = linear.softmax(xs @ w[:-1] + w[-1])
        p[np.arange(len(ys)), ys] -= 1
        grad = xs.T @ (p * weight[:, None]) + w[:-1]
        assert np.abs(grad).max() < 1e-3 and np.abs((p * weight[:, None]).sum(axis=0)).max() < 1e-3


def test_one_scan_serves_all_folds(data, monkeypatch):
    df = data[0]
    scans, one = [], linear.summed
    monkeypatch.setattr(linear, "summed", lambda *a: scans.append(1) or one(*a))
    packed = passes.pack(df)
    linear.fit(packed, [0], 3, False)
    alone = len(scans)
    scans.clear()
    linear.fit(packed, [0, 1, 2, 3], 3, False)
    assert len(scans) <= alone + 3


@pytest.mark.parametrize("head", ["linear", heads.make_mlp(8, 20), heads.make_trees(5, 4)])
def test_a_fold_never_sees_its_own_labels(data, head):
    df = data[0]
    spoilt = df.withColumn("label", F.when(F.col("fold") == 2, (F.col("label") + 1) % 3).otherwise(F.col("label")).cast("int"))
    a, b = ({r["key"]: r["probs"] for r in heads.cross_val_oof(d, head, 3).where("fold = 2").collect()} for d in (df, spoilt))
    assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-6) for i in a)


# --- network --------------------------------------------------------------------------------------

def plain_network(x, y, check, hidden, k, seed, epochs, index=0):
    """Mini-batch Adam written out, in the order the operator documents."""
    d = x.shape[1]
    x = x.astype(np.float32)
    net = neural.start(d, hidden, k, seed)
    w = [p.copy() for p in neural.unflatten(net.theta, d, hidden, k)]
    m, v, t, curve = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0, []
    rows = np.flatnonzero(~check)
    for epoch in range(epochs):
        order = rows[np.random.default_rng([seed, epoch, index]).permutation(len(rows))]
        total = 0.0
        for i in range(0, len(order), 200):
            xb, yb = x[order[i:i + 200]], y[order[i:i + 200]]
            a = np.maximum(xb @ w[0] + w[1], 0)
            z = a @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            total -= np.log(p[np.arange(len(yb)), yb]).sum()
            e = (p - np.eye(k)[yb]) / len(yb)
            da = (e @ w[2].T) * (a > 0)
            g = [xb.T @ da + 1e-4 * w[0] / len(yb), da.sum(0), a.T @ e + 1e-4 * w[2] / len(yb), e.sum(0)]
            t += 1
            for j in range(4):
                m[j] = 0.9 * m[j] + 0.1 * g[j]
                v[j] = 0.999 * v[j] + 0.001 * g[j] ** 2
                w[j] = w[j] - (1e-3 * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t) * m[j] / (np.sqrt(v[j]) + 1e-8)).astype(np.float32)
        z = np.maximum(x[check] @ w[0] + w[1], 0) @ w[2] + w[3]
        z -= z.max(1, keepdims=True)
        curve.append((total / len(rows), float((np.log(np.exp(z).sum(1)) - z[np.arange(check.sum()), y[check]]).mean())))
    return curve


def test_loss_curve_equals_a_plain_run(spark):
    x, y, fold = drawn(900, 6)
    df = vec_rows(spark, x, y, fold)
    flags = {r["key"]: r["a"] for r in df.select("key", neural.aside(0.1, 7).alias("a")).collect()}
    packed = passes.pack(df, neural.aside(0.1, 7), tasks=1)
    order = [int(np.flatnonzero((x == row).all(axis=1))[0]) for b in packed.blocks.collect() for row in b.x]
    _, curves = neural.fit(packed, [None], 3, 7, hidden=16, epochs=12)
    want = plain_network(x[order], y[order], np.array([flags[i] for i in order]), 16, 3, 7, 12)
    assert np.allclose(np.array(curves[None], dtype=float), want, rtol=2e-3, atol=2e-4)
    assert curves[None][-1][0] < curves[None][0][0]


def test_several_tasks_learn_as_well_and_stop_early(spark):
    x, y, fold = drawn(1200, 6, seed=4)
    df = vec_rows(spark, x, y, fold)
    last = {}
    for tasks in (1, 4):
        _, curves = neural.fit(passes.pack(df, neural.aside(0.1, 7), tasks=tasks), [0, None], 3, 7, hidden=64, epochs=120, patience=3, tol=5e-3)
        assert all(len(c) < 120 for c in curves.values())
        last[tasks] = min(h for _, h in curves[None])
    assert last[4] < last[1] + 0.1 and last[4] < 0.5  # log 3 without learning


def test_held_out_loss_is_taken_in_blocks(monkeypatch):
    x, y, _ = drawn(500, 6)
    x = x.astype(np.float32)
    parts = neural.unflatten(neural.start(6, 16, 3, 1).theta, 6, 16, 3)
    whole = -np.log(neural.forward(x, parts)[1][np.arange(500), y]).sum(dtype=float)
    seen, one = [], neural.forward
    monkeypatch.setattr(neural, "forward", lambda x, p: seen.append(len(x)) or one(x, p))
    assert np.isclose(neural.loss_of(x, y, parts, block=64), whole, rtol=1e-5) and max(seen) == 64 and sum(seen) == 500


# --- trees ----------------------------------------------------------------------------------------

def plain_tree(bins, g, h, leaves, least_rows):
    """Best-first growth one leaf at a time: (feature, bin) of the splits by path, and leaf value by row."""
    def best(rows):
        top = None
        for f in range(bins.shape[1]):
            for b in range(bins[:, f].max() + 1):
                left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                if min(len(left), len(right)) < least_rows or min(h[left].sum(), h[right].sum()) < 1e-3:
                    continue
                gain = sum(g[r].sum() ** 2 / h[r].sum() for r in (left, right)) - g[rows].sum() ** 2 / h[rows].sum()
                if gain > 1e-12 and (top is None or gain > top[0] + 1e-9):
                    top = (gain, f, b, left, right)
        return top

    value, parts, splits = np.zeros(len(g)), [((), np.arange(len(g)))], {}
    found = {(): best(parts[0][1])}
    while len(parts) < leaves:
        able = [(found[p][0], p) for p, _ in parts if found[p] is not None]
        if not able:
            break
        _, path = max(able, key=lambda a: a[0])
        _, f, b, left, right = found[path]
        splits[path] = (f, b)
        parts = [p for p in parts if p[0] != path] + [((*path, 0), left), ((*path, 1), right)]
        found[(*path, 0)], found[(*path, 1)] = best(left), best(right)
    if len(parts) > 1:
        for _, rows in parts:
            value[rows] = -trees.RATE * g[rows].sum() / h[rows].sum()
    return splits, value


def splits_of(tree):
    out, todo = {}, [(0, ())]
    while todo:
        node, path = todo.pop()
        if tree.feature[node] >= 0:
            out[path] = (tree.feature[node], tree.bin[node])
            todo += [(tree.left[node], (*path, 0)), (tree.right[node], (*path, 1))]
    return out


def test_trees_equal_growth_leaf_by_leaf(spark):
    x, y, fold = drawn(300, 4, seed=9)
    df = vec_rows(spark, x, y, fold)
    limits = trees.fit_bins(df, bins=16)
    packed = passes.pack(df, tasks=3)
    kwargs = dict(rounds=4, leaves=7, least_rows=10)
    here = trees.fit(packed, limits, [1, None], 3, True, **kwargs)
    spread = trees.fit(packed, limits, [1, None], 3, True, local_entries=0, **kwargs)
    bins = trees.binned(x, limits).astype(int)
    for m in (1, None):
        rows = np.ones(len(y), dtype=bool) if m is None else fold != m
        b, t = bins[rows], y[rows]
        w = (len(t) / (3 * np.bincount(t, minlength=3)))[t]
        scores = np.tile(np.log(np.full(3, 1 / 3)), (len(t), 1))
        for r in range(4):
            p = linear.softmax(scores)
            g, h = w[:, None] * (p - np.eye(3)[t]), w[:, None] * p * (1 - p) * 1.5
            for c in range(3):
                splits, value = plain_tree(b, g[:, c], h[:, c], 7, 10)
                for forest in (here[m], spread[m]):
                    assert splits_of(forest.rounds[r][c]) == splits
                    assert np.allclose(np.array(forest.rounds[r][c].value)[forest.rounds[r][c].leaf_of(b, "bin")], value, atol=1e-9)
                scores[:, c] += value
    raw = trees.probabilities(x, here[None])
    assert np.allclose(raw, trees.probabilities(x, spread[None]), atol=1e-9) and raw.sum(axis=1) == pytest.approx(np.ones(300))


def test_full_settings_beat_the_linear_head_on_a_curved_border(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 3))
    y = np.digitize((x ** 2).sum(axis=1), [1.5, 3.5])
    df = vec_rows(spark, x, y, np.arange(700) % 5)

    def accuracy(head):
        return np.mean([np.argmax(r["probs"]) == r["label"] for r in heads.cross_val_oof(df, head, 3).collect()])

    trees_at, linear_at = accuracy("lgbm"), accuracy("linear")
    assert trees_at > 0.85 > linear_at + 0.2


def test_spread_waves_of_bounded_size(data, monkeypatch):
    """Trees that do not fit one wave take turns; the result stays the same."""
    df, x, _, _ = data
    limits, packed = trees.fit_bins(df, bins=8), passes.pack(df, tasks=2)
    whole = trees.fit(packed, limits, [0, 1], 3, False, rounds=2, leaves=5, least_rows=5, local_entries=0)
    monkeypatch.setattr(trees, "WAVE_BYTES", 1)
    one = trees.fit(packed, limits, [0, 1], 3, False, rounds=2, leaves=5, least_rows=5, local_entries=0)
    assert all(np.allclose(trees.probabilities(x, whole[m]), trees.probabilities(x, one[m]), atol=1e-12) for m in (0, 1))


def test_equal_rows_are_one_cell_of_their_number(spark):
    """Ten times the rows with ten times the least rows: as many cells, the same trees."""
    x, y, fold = drawn(200, 3, seed=5)
    x = np.round(x)
    few = vec_rows(spark, x, y, fold)
    many = vec_rows(spark, np.tile(x, (10, 1)), np.tile(y, 10), np.tile(fold, 10))
    limits = trees.fit_bins(few, bins=8)
    cells = [trees._cells(passes.pack(df, tasks=tasks), limits).collect() for df, tasks in ((few, 2), (many, 3))]
    sizes = [(sum(len(c[1]) for c in part), sum(c[3].sum() for c in part)) for part in cells]
    assert sizes[0][0] == sizes[1][0] < 200 and [n for _, n in sizes] == [200, 2000]
    for entries in (0, 1 << 20):
        a, b = (trees.fit(passes.pack(df, tasks=2), limits, [1], 3, True, rounds=3, leaves=6, least_rows=rows, local_entries=entries, least_hessian=0)[1]
                for df, rows in ((few, 8), (many, 80)))
        assert [splits_of(t) for r in a.rounds for t in r] == [splits_of(t) for r in b.rounds for t in r]
        assert np.allclose(trees.probabilities(x, a), trees.probabilities(x, b), atol=1e-9)


def test_only_the_smaller_child_is_counted(monkeypatch):
    x, y, _ = drawn(400, 4, seed=2)
    limits = [np.unique(np.quantile(c, np.linspace(0, 1, 17)[1:-1])) for c in x.T]
    counted, one = [], trees._Leaves.counted
    monkeypatch.setattr(trees._Leaves, "counted", lambda self, path: counted.append((path, 400 if self.rows[path] is None else len(self.rows[path]))) or one(self, path))
    forest = trees.boost(trees.binned(x, limits), y, np.ones(400, dtype=int), np.ones(400), np.log(np.full(3, 1 / 3)), limits, 1, 0.05, 8, 10, 1e-3)
    assert len(forest.rounds[0][0].feature) == 15
    assert all(n <= 200 for path, n in counted if path) and len([p for p, _ in counted if not p]) == 3


def jobs_of(spark, name, work):
    """What work() returns, and the number of jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_local_trees_grow_in_slices_of_rounds(spark, data, monkeypatch):
    """No task holds its core for all rounds; the trees do not depend on where the slices end."""
    df, x, _, _ = data
    limits, packed = trees.fit_bins(df, bins=8), passes.pack(df, tasks=2)
    fit = lambda: trees.fit(packed, limits, [0, None], 3, True, rounds=6, leaves=5, least_rows=5)
    monkeypatch.setattr(trees, "SLICE_SECONDS", 0.0)
    short, n_short = jobs_of(spark, "short", fit)
    monkeypatch.setattr(trees, "SLICE_SECONDS", 1e6)
    long, n_long = jobs_of(spark, "long", fit)
    assert n_short - n_long == 3 and [len(short[m].rounds) for m in (0, None)] == [6, 6]  # 6 slices against 1 + 4 + 1
    for m in (0, None):
        assert [splits_of(t) for r in short[m].rounds for t in r] == [splits_of(t) for r in long[m].rounds for t in r]
        assert np.array_equal(trees.probabilities(x, short[m]), trees.probabilities(x, long[m]))


def test_forests_take_few_bytes(data):
    """The driver holds all forests of a grid."""
    df, _, _, _ = data
    forest = trees.fit(passes.pack(df, tasks=2), trees.fit_bins(df, bins=32), [None], 3, True, rounds=20, least_rows=5)[None]
    nodes = sum(len(t.feature) for r in forest.rounds for t in r)
    assert nodes > 1000 and len(pickle.dumps([forest.prior, *vars(forest).values()])) < 16 * nodes


def test_a_single_task_takes_several_epochs(spark, data, monkeypatch):
    df, _, _, _ = data
    fit = lambda: neural.fit(passes.pack(df, neural.aside(0.1, 7), tasks=1), [0, None], 3, 7, hidden=8, epochs=20, patience=4, tol=1e-3)
    monkeypatch.setattr(neural, "SLICE_SECONDS", 0.0)
    (one, curves), n_one = jobs_of(spark, "one", fit)
    monkeypatch.setattr(neural, "SLICE_SECONDS", 1e6)
    (many, same), n_many = jobs_of(spark, "many", fit)
    assert curves == same and n_one - n_many >= max(map(len, curves.values())) - 4
    assert all(np.array_equal(a, b) for m in (0, None) for a, b in zip(one[m], many[m]))
