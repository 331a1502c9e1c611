"""Decision tuning: class multipliers and ensemble weights, with honest nested validation.

All candidates are scored in one scan. Each task adds up a (candidate, fold, label, pred) count
table, so what is shuffled depends on the candidates and classes, not on the rows. Counts add
across folds, hence full tuning and every nested split come from the same table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions import probs as P
from foldwright.functions.probs import linspace
from foldwright.operators.metrics import macro_f1_of, wide_confusion
from foldwright.operators.single import beside
from foldwright.session import freeze

BASELINE = -1


def multiplier_grid(lo: float = 0.5, hi: float = 2.0, steps: int = 30) -> list[list[float]]:
    """Three classes, the first fixed at 1; the second varies slowest. The index is the grid id."""
    axis = linspace(lo, hi, steps)
    return [[1.0, a, b] for a in axis for b in axis]


def simplex_candidates(n: int, dim: int, seed: int = 42) -> list[list[float]]:
    """n ensemble weight vectors drawn evenly from the simplex."""
    return np.random.default_rng(seed).dirichlet(np.ones(dim), size=n).tolist()


def _by_prefix(candidates: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates that differ only in the last class: (common weights, last weights ascending, ids)."""
    groups: dict[tuple, list[int]] = {}
    for i, w in enumerate(candidates):
        groups.setdefault(tuple(w[:-1]), []).append(i)
    out = []
    for common, ids in groups.items():
        ids = np.array(ids)
        ids = ids[np.argsort(candidates[ids, -1], kind="stable")]
        out.append((np.array(common), candidates[ids, -1], ids))
    return out


def _first_above(best: np.ndarray, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per row, the first position whose p * weight exceeds best (len(weights) if none).

    The quotient gives the place up to rounding; the products decide, as in a direct comparison.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        at = np.searchsorted(weights, best / p, side="right")
    while True:
        high = (at > 0) & (p * weights[np.maximum(at - 1, 0)] > best)
        if not high.any():
            break
        at -= high
    while True:
        low = (at < len(weights)) & (p * weights[np.minimum(at, len(weights) - 1)] <= best)
        if not low.any():
            return at
        at += low


def _count_multipliers(groups, n_candidates: int, k: int, ps: list[np.ndarray], code: np.ndarray,
                       cells: int) -> np.ndarray:
    """counts[candidate, cell, pred]. Along the last weight a row changes class once, so one
    histogram of the turning points serves all candidates of a prefix."""
    counts = np.empty((n_candidates, cells, k), dtype=np.int64)
    for common, weights, ids in groups:
        best, arg = ps[0] * common[0], np.zeros(len(code), dtype=np.int64)
        for c in range(1, k - 1):
            score = ps[c] * common[c]
            np.copyto(arg, c, where=score > best)  # strict: the first maximum wins
            np.maximum(best, score, out=best)
        m = len(weights)
        turn = _first_above(best, ps[k - 1], weights)
        h = np.bincount((code * (k - 1) + arg) * (m + 1) + turn, minlength=cells * (k - 1) * (m + 1))
        h = h.reshape(cells, k - 1, m + 1)
        last = h.cumsum(axis=2)[:, :, :m]
        counts[ids, :, :k - 1] = np.moveaxis(h.sum(axis=2)[:, :, None] - last, 2, 0)
        counts[ids, :, k - 1] = last.sum(axis=1).T
    return counts


def _count_blends(candidates: np.ndarray, k: int, sets: list[list[np.ndarray]], code: np.ndarray,
                  cells: int) -> np.ndarray:
    counts = np.empty((len(candidates), cells, k), dtype=np.int64)
    cell_of = [code * k + c for c in range(k)]
    for i, w in enumerate(candidates):
        best = at = None
        for c in range(k):
            score = sets[0][c] * w[0]
            for s in range(1, len(sets)):
                score += sets[s][c] * w[s]
            if best is None:
                best, at = score, cell_of[0].copy()
            else:
                np.copyto(at, cell_of[c], where=score > best)
                np.maximum(best, score, out=best)
        counts[i] = np.bincount(at, minlength=cells * k).reshape(cells, k)
    return counts


def _count_candidates(candidates: np.ndarray, n_sets: int, k: int):
    """Task function: count (candidate, fold, label, pred) over its rows.

    One probability set: the candidate scales the classes. Several: it blends the sets.
    """
    groups = _by_prefix(candidates) if n_sets == 1 else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if b.empty:
                continue
            sets = [[b[f"p{s}_{c}"].to_numpy() for c in range(k)] for s in range(n_sets)]
            fold, label = b["fold"].to_numpy().astype(np.int64), b["label"].to_numpy()
            base = fold.min()
            cells, code = np.unique((fold - base) * k + label, return_inverse=True)
            if groups is not None:
                counts = _count_multipliers(groups, len(candidates), k, sets[0], code, len(cells))
            else:
                counts = _count_blends(candidates, k, sets, code, len(cells))
            for j, cell in enumerate(cells):
                at = (int(cell // k + base), int(cell % k))
                totals[at] = counts[:, j] + totals[at] if at in totals else counts[:, j].copy()
        for (fold, label), n in totals.items():
            cand, pred = np.nonzero(n)
            yield pd.DataFrame({"cand": cand.astype(np.int32), "fold": np.int32(fold), "label": np.int32(label),
                                "pred": pred.astype(np.int32), "n": n[cand, pred]})

    return run


def _countable(k: int, probs: Sequence[str]):
    """The label; an error where a row cannot be counted, instead of counting it elsewhere or dropping it."""
    finite = F.lit(True)
    for p in probs:
        finite = finite & F.coalesce(F.abs(F.col(p)) < float("inf"), F.lit(False)) & ~F.isnan(p)
    known = F.coalesce(F.col("label").between(0, k - 1), F.lit(False)) & F.col("fold").isNotNull()
    message = F.concat(F.lit("cannot tune on a row with fold "), F.coalesce(F.col("fold").cast("string"), F.lit("NULL")),
                       F.lit(", label "), F.coalesce(F.col("label").cast("string"), F.lit("NULL")),
                       F.when(finite, "").otherwise(" and a missing or non-finite probability"))
    return F.when(known & finite, F.col("label")).otherwise(F.raise_error(message).cast("int"))


def candidate_counts(df: DataFrame, candidates: Sequence[Sequence[float]], prob_cols: Sequence[str],
                     k: int = 3) -> DataFrame:
    """(cand, fold, label, pred, n) for every candidate; df needs fold, label and the probability arrays.

    A null fold, a label that is null or outside 0..k-1, and a probability that is null, NaN or infinite are errors.
    """
    table = np.array(candidates, dtype=np.float64)
    rows = df.select(
        F.col("fold").cast("int").alias("fold"), F.col("label").cast("int").alias("label"),
        *[c.alias(f"p{s}_{i}") for s, name in enumerate(prob_cols) for i, c in enumerate(P.entries(name, k))])
    rows = rows.withColumn("label", _countable(k, [c for c in rows.columns if c not in ("fold", "label")]))
    part = rows.mapInPandas(_count_candidates(table, len(prob_cols), k),
                            "cand int, fold int, label int, pred int, n bigint")
    return part.groupBy("cand", "fold", "label", "pred").agg(F.sum("n").alias("n"))


def _scores(counts: DataFrame, k: int) -> DataFrame:
    """Per (cand, fold): F1 on the fold, F1 on all other folds, F1 on everything."""
    wide = wide_confusion(counts, k, ("cand", "fold"), n=F.col("n"))
    cells = [(i, j) for i in range(k) for j in range(k)]
    # One row per candidate and fold: a window over candidates x folds rows.
    w = Window.partitionBy("cand")
    both = wide.select("*", *[F.sum(f"c_{i}_{j}").over(w).alias(f"t_{i}_{j}") for i, j in cells])

    def rest(i, j):
        return F.col(f"t_{i}_{j}") - F.col(f"c_{i}_{j}")

    def whole(i, j):
        return F.col(f"t_{i}_{j}")

    return both.select(
        "cand", "fold", macro_f1_of(k).alias("f1_fold"), macro_f1_of(k, rest).alias("f1_rest"),
        macro_f1_of(k, whole).alias("f1_all"))


def _nested(scores: DataFrame) -> DataFrame:
    """Per held-out fold: the candidate best on the other folds and its F1 on the fold."""
    return scores.groupBy("fold").agg(
        F.max_by("cand", F.struct("f1_rest", "_tie")).alias("cand"),
        F.max("f1_rest").alias("tune_f1"),
        F.max_by("f1_fold", F.struct("f1_rest", "_tie")).alias("nested_f1"))


def _full(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.max_by("cand", F.struct("f1_all", "_tie")).alias("cand"), F.max("f1_all").alias("full_tuned_f1"),
        F.max(F.when(F.col("cand") == BASELINE, F.col("f1_all"))).alias("baseline_f1"))


def _named(rows: DataFrame, candidates: Sequence[Sequence[float]], first: int = BASELINE) -> DataFrame:
    """Add w0, w1, ... of each row's candidate from the candidate table (a few hundred rows)."""
    names = [f"w{d}" for d in range(len(candidates[0]))]
    table = pd.DataFrame(list(candidates), columns=names, dtype="float64")
    table.insert(0, "cand", np.arange(first, first + len(table), dtype=np.int32))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(table)), "cand")


def _shift(counts: DataFrame) -> DataFrame:
    """Candidate 0 is the baseline; grid ids start at 0 behind it."""
    return counts.withColumn("cand", F.col("cand") - 1)


def multiplier_counts(df: DataFrame, grid: Sequence[Sequence[float]], k: int = 3, probs: str = "probs") -> DataFrame:
    """Counts of every grid point and of the baseline (id -1, all multipliers 1)."""
    return _shift(candidate_counts(df, [[1.0] * k, *grid], [probs], k))


def tune_multipliers(df: DataFrame, grid: Sequence[Sequence[float]] | None = None, k: int = 3,
                     counts: DataFrame | None = None, probs: str = "probs") -> DataFrame:
    """One row: grid_id, w0.., baseline_f1, best_f1, gain, verdict.

    The baseline wins ties, then the earliest grid point.
    """
    grid = multiplier_grid() if grid is None else grid
    counts = multiplier_counts(df, grid, k, probs) if counts is None else counts
    wide = wide_confusion(counts, k, ("cand",), n=F.col("n")).select("cand", macro_f1_of(k).alias("f1_all"))
    best = _named(_full(wide.withColumn("_tie", -F.col("cand"))), [[1.0] * k, *grid])
    gain = F.col("full_tuned_f1") - F.col("baseline_f1")
    return best.select(
        F.col("cand").alias("grid_id"), *[f"w{i}" for i in range(k)], "baseline_f1",
        F.col("full_tuned_f1").alias("best_f1"), gain.alias("gain"),
        F.when(gain < 1e-5, "argmax_is_best").when(gain > 0.003, "check_nested").otherwise("small_gain")
        .alias("verdict"))


def apply_multipliers(df: DataFrame, weights: Sequence[float], probs: str = "probs") -> DataFrame:
    return df.withColumn("predicted", P.scale_argmax(probs, list(weights)))


def _summary(nested: DataFrame, full: DataFrame) -> DataFrame:
    rows = nested.agg(F.avg("nested_f1").alias("nested_mean"), F.min("nested_f1").alias("nested_min"),
                      F.stddev_pop("nested_f1").alias("nested_std"), F.count(F.lit(1)).alias("n_folds"))
    row = beside(rows, full)
    gap = F.col("full_tuned_f1") - F.col("nested_mean")
    return row.withColumn("illusion_gap", gap).withColumn(
        "verdict", F.when(gap > 0.003, "too_aggressive").when(gap > 0.001, "partly_illusion").otherwise("honest"))


def nested_multipliers(df: DataFrame, grid: Sequence[Sequence[float]] | None = None, k: int = 3,
                       counts: DataFrame | None = None, probs: str = "probs") -> tuple[DataFrame, DataFrame]:
    """(per held-out fold, one-row summary) of tuning on the other folds only."""
    grid = multiplier_grid() if grid is None else grid
    if counts is None:  # used twice below; candidates x folds x K x K rows
        counts = freeze(multiplier_counts(df, grid, k, probs))
    scores = _scores(counts, k).withColumn("_tie", -F.col("cand"))  # equal F1: the smaller id wins
    candidates, ws = [[1.0] * k, *grid], [f"w{i}" for i in range(k)]
    nested = _nested(scores)
    per_fold = _named(nested, candidates).select("fold", F.col("cand").alias("grid_id"), *ws, "tune_f1", "nested_f1")
    full = _named(_full(scores), candidates).select(
        F.col("cand").alias("grid_id"), *ws, "baseline_f1", "full_tuned_f1")
    return per_fold, _summary(nested, full)


def nested_weight_search(df: DataFrame, prob_cols: Sequence[str], n: int = 200, seed: int = 42, k: int = 3,
                         include_uniform: bool = False) -> tuple[DataFrame, DataFrame]:
    """(per held-out fold, one-row summary) of choosing ensemble weights.

    Candidate -1 is the uniform weight. It competes only with include_uniform, otherwise it is
    what remains when every other candidate scores 0.
    """
    dim = len(prob_cols)
    candidates = [[1.0 / dim] * dim, *simplex_candidates(n, dim, seed)]
    counts = freeze(_shift(candidate_counts(df, candidates, prob_cols, k)))
    scores = _scores(counts, k).withColumn("_tie", -F.col("cand"))
    if not include_uniform:
        # Uniform ranks above a zero score only.
        for c in ("f1_rest", "f1_all"):
            scores = scores.withColumn(
                f"_{c}", F.when(F.col("cand") == BASELINE, F.lit(0.0)).otherwise(F.col(c)))
    else:
        scores = scores.withColumns({"_f1_rest": F.col("f1_rest"), "_f1_all": F.col("f1_all")})
    nested = scores.groupBy("fold").agg(
        F.max_by("cand", F.struct("_f1_rest", "_tie")).alias("cand"), F.max("_f1_rest").alias("tune_f1"),
        F.max_by("f1_fold", F.struct("_f1_rest", "_tie")).alias("nested_f1"))
    full = scores.agg(F.max_by("cand", F.struct("_f1_all", "_tie")).alias("cand"),
                      F.max("_f1_all").alias("full_tuned_f1"))
    ws = [f"w{d}" for d in range(dim)]
    per_fold = _named(nested, candidates).select("fold", F.col("cand").alias("cand_id"), *ws, "tune_f1", "nested_f1")
    full = _named(full, candidates).select(F.col("cand").alias("cand_id"), *ws, "full_tuned_f1")
    return per_fold, _summary(nested, full)
