"""Boosted trees for several classes, for all folds at once: softmax gradients, histograms, best-first growth.

Vectors are cut into at most 255 bins per component, at quantiles of a bounded sample. In a round every class of every model gets
one tree, grown leaf by leaf at the largest gain. Growth asks for histograms in waves: a wave names all leaves that best-first
growth would split with what is known, so a tree takes about as many waves as it is deep, not as many as it has leaves. The tree
is the same as if it were grown leaf by leaf.

Rows of one fold and label with equal bins are one weighted row (a cell): every task merges its own, and equal cells of all tasks
meet in a shuffle. Where vectors have few components their number is bounded by the bins, however many rows there are; where
every row differs nothing is lost.

Cells that fit LOCAL_ENTRIES are sent to one task per model, where waves need no exchange; the folds are fitted side by side. A
leaf keeps its rows and histogram there, so only the smaller child of a split is counted and the larger one is the difference.
Such a task takes about SLICE_SECONDS of rounds and leaves its scores with the executors for the next one: jobs beside it get their
turn, and none waits so long that a broadcast times out.
Beyond, a wave is a scan of all tasks: their histograms are added up by (tree, leaf) in a shuffle, each sum is turned into its
best split where it lies, and only splits come to the driver. Trees share a wave as long as a task's histograms stay below
WAVE_BYTES. Scores are kept by the executors and written to the checkpoint folder every CHECKPOINT rounds.
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Generator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession

from foldwright.operators.linear import softmax
from foldwright.operators.passes import Model, Packed
from foldwright.operators.splits import seeded_sample
from foldwright.session import ensure_checkpoint_dir

# Settings of the head.
ROUNDS, RATE, LEAVES, BINS, LEAST_IN_BIN, LEAST_ROWS, LEAST_HESSIAN = 300, 0.05, 31, 255, 3, 20, 1e-3
#: Rows that the bins are fitted on; entries of binned vectors (bytes) sent to a task; bytes of histograms of a wave; rounds between checkpoints.
SAMPLE_ROWS, LOCAL_ENTRIES, WAVE_BYTES, CHECKPOINT = 20_000, 64_000_000, 128_000_000, 10
#: Length of a task of _fit_local.
SLICE_SECONDS = 5.0


@dataclass
class Split:
    """A leaf's best split: rows whose bin of `feature` is at most `bin` go left. sums: gradient, hessian and rows of either side."""
    gain: float
    feature: int
    bin: int
    left: tuple[float, float, float]
    right: tuple[float, float, float]


@dataclass
class Tree:
    """Nodes in arrays; leaves have feature -1. bin and threshold say the same about binned and raw vectors."""
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def grow(self, node: int, split: Split) -> tuple[int, int]:
        a, b = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.left[node], self.right[node] = split.feature, split.bin, a, b
        for column, start in ((self.feature, -1), (self.bin, 0), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column += [start, start]
        return a, b

    def leaf_of(self, x: np.ndarray, cut: str) -> np.ndarray:
        """Node that every row ends in. cut: "bin" for binned rows, "threshold" for raw ones."""
        feature, left, right, limit = (np.asarray(c) for c in (self.feature, self.left, self.right, getattr(self, cut)))
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(rows := rows[feature[at[rows]] >= 0]):
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= limit[node], left[node], right[node])
        return at


def fit_bins(df: DataFrame, bins: int = BINS, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> list[np.ndarray]:
    """Ascending limits per component, about LEAST_IN_BIN sampled rows apart; a value's bin is the number of limits below it."""
    x = np.array([r["vec"] for r in seeded_sample(df.select("key", "vec"), sample_rows, seed).collect()], dtype=float)  # at most sample_rows
    bins = max(2, min(bins, len(x) // LEAST_IN_BIN))
    limits = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
            limits.append(values)
        else:
            limits.append((values[1:] + values[:-1]) / 2)
    return limits


def binned(x: np.ndarray, limits: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(at, x[:, j], side="left") for j, at in enumerate(limits)], axis=1).astype(np.uint8)


def best_split(sums: np.ndarray, least_rows: int, least_hessian: float) -> Split | None:
    """sums: (gradient, hessian, rows) x features x bins. The first of equal gains wins."""
    left = sums.cumsum(axis=2)
    g, h, n = left
    g_all, h_all, n_all = left[:, :, -1:]
    right_h, right_n = h_all - h, n_all - n
    fits = n >= least_rows
    for more in (right_n >= least_rows, h >= least_hessian, right_h >= least_hessian):
        fits &= more
    if not fits.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g * g
        gain /= h
        rest = g_all - g
        rest *= rest
        rest /= right_h
        gain += rest
        gain -= g_all * g_all / h_all
    np.copyto(gain, -np.inf, where=~fits)
    best = int(gain.argmax())
    if not gain.flat[best] > 1e-12:
        return None
    feature, cut = divmod(best, sums.shape[2])
    here = left[:, feature, cut]
    return Split(float(gain[feature, cut]), feature, cut, tuple(here), tuple(left[:, feature, -1] - here))


Known = dict[tuple, Split | None]


def grow(leaves: int, least_rows: int) -> Generator[tuple[Tree, dict[int, tuple]], Known, tuple[Tree, list[tuple[int, tuple]]]]:
    """Best-first growth. Yields the tree so far and {node: name} of the leaves whose histograms it asks for; is sent their best
    splits by name. A name is the path from the root. Returns the tree and (node, sums) of its leaves but the root's. Leaves with too
    few rows for two others are not asked for."""
    known: Known = {}
    while True:
        tree, asked, heap, sums = Tree(), {}, [], {}

        def reach(node: int, path: tuple, rows: float) -> None:
            if rows < 2 * least_rows:
                return
            if path not in known:
                asked[node] = path
            elif known[path] is not None:
                heapq.heappush(heap, (-known[path].gain, len(tree.feature), node, path))

        reach(0, (), np.inf)
        n = 1
        while heap and n < leaves:
            _, _, node, path = heapq.heappop(heap)
            a, b = tree.grow(node, known[path])
            sums.pop(node, None)
            sums[a], sums[b] = known[path].left, known[path].right
            n += 1
            if n < leaves:
                reach(a, (*path, 0), sums[a][2])
                reach(b, (*path, 1), sums[b][2])
        if not asked:  # a leaf not looked at could still come before those that were split
            return tree, list(sums.items())
        known.update((yield tree, asked))


def _gradients(scores: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = scores.shape[1]
    p = softmax(scores)
    h = w[:, None] * p * (1 - p) * (k / (k - 1) if k > 1 else 1.0)
    p[np.arange(len(y)), y] -= 1.0
    return w[:, None] * p, h


def _histograms(bins: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, tree: Tree, asked: dict[int, tuple], n_bins: int) -> np.ndarray:
    """asked leaves x (gradient, hessian, rows) x features x bins, of cells of n rows each."""
    leaf = tree.leaf_of(bins, "bin")
    slot = np.full(len(tree.feature), -1, dtype=np.int64)
    slot[list(asked)] = np.arange(len(asked))
    slot = slot[leaf]
    rows = np.flatnonzero(slot >= 0)
    d = bins.shape[1]
    at = ((slot[rows, None] * d + np.arange(d)) * n_bins + bins[rows]).ravel()
    size = len(asked) * d * n_bins
    out = np.empty((len(asked), 3, d, n_bins))
    for i, v in enumerate((g, h, n)):
        out[:, i] = np.bincount(at, weights=np.repeat(v[rows], d), minlength=size).reshape(len(asked), d, n_bins)
    return out


class _Leaves:
    """Rows and histograms of a tree's leaves by path, over cells that lie here: g, h and rows of a cell, and its bins by feature."""

    def __init__(self, columns: np.ndarray, weights: Sequence[np.ndarray], n_bins: int):
        self.columns, self.weights, self.n_bins = columns, weights, n_bins
        self.rows: dict[tuple, np.ndarray | None] = {(): None}  # None: all
        self.sums: dict[tuple, np.ndarray] = {}

    def part(self, path: tuple, split: Split) -> None:
        """Rows of the two children of a leaf."""
        if (*path, 0) not in self.rows:
            rows, column = self.rows[path], self.columns[split.feature]
            goes = (column if rows is None else column[rows]) <= split.bin
            for side, mine in ((0, goes), (1, ~goes)):
                self.rows[(*path, side)] = np.flatnonzero(mine) if rows is None else rows[mine]

    def counted(self, path: tuple) -> np.ndarray:
        rows, d = self.rows[path], len(self.columns)
        values = self.weights if rows is None else [v[rows] for v in self.weights]
        out = np.empty((3, d, self.n_bins))
        if len(values[0]) < 512:  # few rows: all features at once
            at = ((self.columns if rows is None else self.columns[:, rows]) + (np.arange(d) * self.n_bins)[:, None]).ravel()
            for i, v in enumerate(values):
                out[i] = np.bincount(at, weights=np.tile(v, d), minlength=d * self.n_bins).reshape(d, self.n_bins)
        else:
            for f, column in enumerate(self.columns):
                at = (column if rows is None else column[rows]).astype(np.intp)
                for i, v in enumerate(values):
                    out[i, f] = np.bincount(at, weights=v, minlength=self.n_bins)
        return out

    def histogram(self, path: tuple) -> np.ndarray:
        """(gradient, hessian, rows) x features x bins of a leaf; its parent's is known, and dropped when both children's are."""
        if path in self.sums:
            return self.sums[path]
        if not path:
            self.sums[path] = self.counted(path)
            return self.sums[path]
        above = path[:-1]
        low, high = sorted(((*above, 0), (*above, 1)), key=lambda p: len(self.rows[p]))
        whole, few = self.sums.pop(above), self.counted(low)
        many = np.subtract(whole, few, out=whole)
        many[:2] *= many[2] != 0  # no rows: the difference is rounding
        self.sums[low], self.sums[high] = few, many
        return self.sums[path]


def _finish(tree: Tree, leaves: list, rate: float, limits: Sequence[np.ndarray]) -> Tree:
    for node, (g, h, _) in leaves:
        tree.value[node] = -rate * g / h
    tree.threshold = [float(limits[f][b]) if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.bin)]
    return tree


@dataclass(frozen=True)
class Forest:
    """Scores before the first round (minus infinity for absent classes), and a tree per round and class.

    The nodes of all trees lie one after the other, in as few bytes as they need: a grid holds tens of thousands of trees on the
    driver. A node has a feature, or -1 and a value in place of a threshold; the right child stands behind the left one. ends: where
    each tree's nodes end.
    """
    prior: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    number: np.ndarray
    left: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, prior: np.ndarray, rounds: Sequence[Sequence[Tree]]) -> Forest:
        trees = [t for r in rounds for t in r]
        feature, cut, left = (np.array([v for t in trees for v in getattr(t, c)], dtype=np.int64) for c in ("feature", "bin", "left"))
        number = [a if f >= 0 else v for t in trees for f, a, v in zip(t.feature, t.threshold, t.value)]
        small = [v.astype(np.min_scalar_type(-1 - v.max(initial=0))) for v in (feature, left)]
        return cls(prior, small[0], cut.astype(np.uint8), np.array(number, dtype=float), small[1], np.cumsum([len(t.feature) for t in trees], dtype=np.int64))

    def then(self, more: Sequence[Forest]) -> Forest:
        """This forest and the rounds of later ones."""
        parts = [self, *more]
        begin = np.cumsum([0, *(len(p.feature) for p in parts)])
        ends = np.concatenate([p.ends + at for p, at in zip(parts, begin)])
        return Forest(self.prior, *(np.concatenate([getattr(p, c) for p in parts]) for c in ("feature", "bin", "number", "left")), ends)

    @property
    def rounds(self) -> list[list[Tree]]:
        k, begin, trees = len(self.prior), 0, []
        for end in self.ends:
            feature, cut, number, left = (v[begin:end] for v in (self.feature, self.bin, self.number, self.left))
            inner = feature >= 0
            trees.append(Tree(feature, cut, np.where(inner, number, 0.0), left, np.where(inner, left.astype(np.int64) + 1, 0), np.where(inner, 0.0, number)))
            begin = end
        return [trees[i:i + k] for i in range(0, len(trees), k)]


def _prior(counts: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(counts / max(counts.sum(), 1e-300))


def boost(bins: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray, prior: np.ndarray, limits: Sequence[np.ndarray], rounds: int, rate: float,
          leaves: int, least_rows: int, least_hessian: float, scores: np.ndarray | None = None) -> Forest:
    """Rounds over cells that lie here: bins, label, number of rows and weight of a row. scores: those of earlier rounds; these rounds
    are added to them."""
    n_bins = max((len(at) for at in limits), default=0) + 1
    columns, n = np.ascontiguousarray(bins.T), n.astype(float)
    scores, out = np.tile(prior, (len(y), 1)) if scores is None else scores, []
    for _ in range(rounds):
        g, h = (np.ascontiguousarray(v.T) for v in _gradients(scores, y, w * n))
        out.append([])
        for c in range(len(prior)):
            tree = Tree()
            if np.isfinite(prior[c]):
                state, known = _Leaves(columns, (g[c], h[c], n), n_bins), {}
                run = grow(leaves, least_rows)
                _, asked = next(run)
                while True:
                    found = {}
                    for path in asked.values():
                        if path:
                            state.part(path[:-1], known[path[:-1]])
                        found[path] = best_split(state.histogram(path), least_rows, least_hessian)
                    known.update(found)
                    try:
                        _, asked = run.send(found)
                    except StopIteration as done:
                        tree = _finish(*done.value, rate, limits)
                        break
                _add_values(tree, state, known, scores[:, c])
            out[-1].append(tree)
    return Forest.of(prior, out)


def _add_values(tree: Tree, state: _Leaves, known: Known, scores: np.ndarray) -> None:
    """Add every leaf's value to the scores of its rows."""
    todo: list[tuple[int, tuple]] = [(0, ())] if tree.feature[0] >= 0 else []
    while todo:
        node, path = todo.pop()
        if tree.feature[node] < 0:
            scores[state.rows[path]] += tree.value[node]
        else:
            state.part(path, known[path])
            todo += [(tree.left[node], (*path, 0)), (tree.right[node], (*path, 1))]


Cells = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # bins, label, fold, rows


def _merged(cells: Sequence[Cells]) -> Cells:
    """Cells with equal bins, label and fold as one, in the order of their bytes."""
    bins, y, fold, n = (np.concatenate(c) for c in zip(*cells))
    key = np.ascontiguousarray(np.concatenate([bins, y.astype(">i8").view(np.uint8).reshape(-1, 8), fold.astype(">i8").view(np.uint8).reshape(-1, 8)], axis=1))
    _, first, cell = np.unique(key.view(f"V{key.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return bins[first], y[first], fold[first], np.bincount(cell.ravel(), weights=n, minlength=len(first)).astype(np.int64)


def _cells(packed: Packed, limits: Sequence[np.ndarray]) -> RDD:
    """The rows as cells, dealt by their bins."""
    width = packed.blocks.getNumPartitions()

    def deal(part):
        own = [(binned(b.x, limits), b.y, b.fold, np.ones(len(b.y), dtype=np.int64)) for b in part]
        if not own:
            return
        bins, y, fold, n = _merged(own)
        mixed = (bins.astype(np.uint64) + np.uint64(1)) @ np.random.default_rng(1).integers(1, 1 << 63, bins.shape[1], dtype=np.uint64)
        to = ((mixed >> np.uint64(33)) % np.uint64(width)).astype(np.int64)
        for i in np.unique(to).tolist():
            rows = to == i
            yield i, (bins[rows], y[rows], fold[rows], n[rows])

    dealt = packed.blocks.mapPartitions(deal).partitionBy(width, lambda i: i)
    return dealt.mapPartitions(lambda part: [_merged(own)] if (own := [c for _, c in part]) else [])


def _fit_local(cells: RDD, models, limits, weights, priors, settings) -> dict[Model, Forest]:
    """One task per model and slice of rounds, each with all (bounded) cells."""
    rounds, *rest = settings
    sc, parts = cells.context, cells.collect()  # at most LOCAL_ENTRIES bytes
    sent = sc.broadcast(tuple(np.concatenate(c) for c in zip(*parts)))
    state = sc.parallelize([(i, None, None, 0.0) for i in range(len(models))], len(models))

    def step(n_rounds: int):
        def one(element):
            i, scores, _, _ = element
            (bins, y, fold, n), began = sent.value, time.monotonic()
            rows = np.ones(len(y), dtype=bool) if models[i] is None else fold != models[i]
            scores = np.tile(priors[i], (int(rows.sum()), 1)) if scores is None else scores.copy()
            forest = boost(bins[rows], y[rows], n[rows], weights[i][y[rows]], priors[i], limits, n_rounds, *rest, scores)
            return i, scores, forest, time.monotonic() - began

        return one

    grown: dict[int, list[Forest]] = {i: [] for i in range(len(models))}
    done, n_rounds = 0, 1
    try:
        while done < rounds:
            n_rounds = min(n_rounds, rounds - done)
            # The number of rounds is fixed before the task begins, so a lost one gives the same trees again.
            after = state.map(step(n_rounds)).persist(StorageLevel.MEMORY_AND_DISK)
            found = after.map(lambda e: (e[0], e[2], e[3])).collect()
            state.unpersist()
            state, done, longest = after, done + n_rounds, 0.0
            for i, forest, seconds in found:
                grown[i].append(forest)
                longest = max(longest, seconds)
            n_rounds = max(1, min(4 * n_rounds, int(SLICE_SECONDS * n_rounds / max(longest, 1e-3))))
        return {m: Forest.of(priors[i], []).then(grown[i]) for i, m in enumerate(models)}
    finally:
        state.unpersist()
        sent.destroy()


def _fit_spread(cells: RDD, models, limits, weights, priors, settings) -> dict[Model, Forest]:
    """A wave is a scan; histograms meet by (tree, leaf) in a shuffle and leave it as splits."""
    rounds, rate, leaves, least_rows, least_hessian = settings
    n_bins, k = max((len(at) for at in limits), default=0) + 1, priors.shape[1]
    sc, width = cells.context, cells.getNumPartitions()
    ensure_checkpoint_dir(SparkSession.builder.getOrCreate())
    state = cells.map(lambda c: (*c, np.tile(priors, (len(c[1]), 1, 1)))).persist(StorageLevel.MEMORY_AND_DISK)
    forests = {m: [] for m in models}
    per_leaf = len(limits) * n_bins * 24

    def emit(wave):
        def run(part):
            sums: dict = {}
            for bins, y, fold, n, scores in part:
                for i, m in enumerate(models):
                    trees = [(c, wave.value[i, c]) for c in range(k) if (i, c) in wave.value]
                    if not trees:
                        continue
                    rows = slice(None) if m is None else fold != m
                    g, h = _gradients(scores[rows, i], y[rows], weights[i][y[rows]] * n[rows])
                    for c, (partial, asked) in trees:
                        found = _histograms(bins[rows], g[:, c], h[:, c], n[rows], partial, asked, n_bins)
                        for path, s in zip(asked.values(), found):
                            sums[i, c, path] = sums[i, c, path] + s if (i, c, path) in sums else s
            return iter(sums.items())

        return run

    for r in range(rounds):
        runs = {(i, c): grow(leaves, least_rows) for i in range(len(models)) for c in range(k) if np.isfinite(priors[i, c])}
        open_trees = {key: next(run) for key, run in runs.items()}
        grown = {(i, c): Tree() for i in range(len(models)) for c in range(k)}
        while open_trees:
            wave, held = {}, 0
            for key, (partial, asked) in open_trees.items():
                if wave and held + len(asked) * per_leaf > WAVE_BYTES:
                    break
                wave[key], held = (partial, asked), held + len(asked) * per_leaf
            sent = sc.broadcast(wave)
            splits = state.mapPartitions(emit(sent)).reduceByKey(lambda a, b: a + b, width).mapValues(
                lambda s: best_split(s, least_rows, least_hessian)).collect()  # one per asked leaf
            sent.destroy()
            answers: dict = {key: {path: None for path in asked.values()} for key, (_, asked) in wave.items()}
            for (i, c, path), split in splits:
                answers[i, c][path] = split
            for key, known in answers.items():
                try:
                    open_trees[key] = runs[key].send(known)
                except StopIteration as done:
                    grown[key] = _finish(*done.value, rate, limits)
                    del open_trees[key]
        for i, m in enumerate(models):
            forests[m].append(Forest.of(priors[i], [[grown[i, c] for c in range(k)]]))
        new = sc.broadcast(grown)

        def scored(element, new=new):
            bins, y, fold, n, scores = element
            scores = scores.copy()
            for (i, c), tree in new.value.items():
                scores[:, i, c] += np.array(tree.value)[tree.leaf_of(bins, "bin")]
            return bins, y, fold, n, scores

        after = state.map(scored).persist(StorageLevel.MEMORY_AND_DISK)
        if (r + 1) % CHECKPOINT == 0:
            after.checkpoint()
        after.count()
        state.unpersist()
        state = after
    state.unpersist()
    return {m: Forest.of(priors[i], []).then(forests[m]) for i, m in enumerate(models)}


def fit(packed: Packed, limits: Sequence[np.ndarray], models: Sequence[Model], k: int, balanced: bool, rounds: int = ROUNDS, rate: float = RATE,
        leaves: int = LEAVES, least_rows: int = LEAST_ROWS, least_hessian: float = LEAST_HESSIAN, local_entries: int = LOCAL_ENTRIES) -> dict[Model, Forest]:
    """A forest per model. Both plans give the same trees but for the rounding of sums."""
    weights = packed.weights(models, k, balanced)
    priors = np.array([_prior(packed.class_counts(m, k) * weights[i]) for i, m in enumerate(models)])
    settings = (rounds, rate, leaves, least_rows, least_hessian)
    cells = _cells(packed, limits).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        small = cells.map(lambda c: len(c[1])).sum() * packed.dim <= local_entries
        return (_fit_local if small else _fit_spread)(cells, list(models), limits, weights, priors, settings)
    finally:
        cells.unpersist()


def probabilities(x: np.ndarray, model: Forest, _=None) -> np.ndarray:
    scores = np.tile(model.prior, (len(x), 1))
    for trees in model.rounds:
        for c, tree in enumerate(trees):
            if len(tree.feature) > 1:
                scores[:, c] += tree.value[tree.leaf_of(x, "threshold")]
    return softmax(scores)
