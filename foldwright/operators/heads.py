"""Cheap classifier heads on frozen vectors and cross-validated out-of-fold probabilities.

A head is a pair of functions registered by name, so users can add their own:
    fit(train, n_classes, seed, balanced) -> model
    predict(model, rows, n_classes) -> rows with a probs array
and, where it can, a third one that fits the models of all folds with the same scans:
    fit_folds(rows, folds, n_classes, seed, balanced) -> model, whose predict() uses for each row the one that has not seen it
Tables carry key, fold, label, vec.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.operators import knn, linear, neural, trees
from foldwright.operators.metrics import fold_consistency, with_pred
from foldwright.operators.passes import folds_of, pack, predicted
from foldwright.operators.validate import assert_ok, validate_probs

# Settings of the heads (those of the network and the trees stand in their modules).
LINEAR_C, LINEAR_ITERATIONS = 1.0, 3000
NEIGHBOURS = 15


@dataclass(frozen=True)
class Head:
    fit: Callable
    predict: Callable
    fit_folds: Callable | None = None


def _of_models(fit_models: Callable, probabilities: Callable) -> Head:
    """A head whose fit_models(df, models, k, seed, balanced) gives one model for each fold to leave out (None: leave out none)."""
    def fit(train, k, seed, balanced):
        return fit_models(train, [None], k, seed, balanced)

    def predict(models, df, k):
        return predicted(df, k, probabilities, models)

    return Head(fit, predict, fit_models)


def _fit_linear(df, models, k, seed, balanced):
    """Multinomial logistic regression, penalised as C on the summed loss."""
    packed = pack(df)
    try:
        return linear.fit(packed, models, k, balanced, LINEAR_C, LINEAR_ITERATIONS)
    finally:
        packed.release()


def make_mlp(hidden: int = neural.HIDDEN, epochs: int = neural.EPOCHS, held_out: float = neural.HELD_OUT,
             patience: int = neural.PATIENCE, tasks: int | None = None) -> Head:
    """One hidden layer of rectified units with early stopping; class weights do not apply. held_out=0 runs all epochs."""
    def fit_models(df, models, k, seed, balanced):
        rows = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
        packed = pack(df, neural.aside(held_out, seed), tasks or neural.tasks_for(rows["n"], rows["dim"] or 0))
        try:
            return neural.fit(packed, models, k, seed, hidden, epochs, patience=patience)[0]
        finally:
            packed.release()

    return _of_models(fit_models, neural.probabilities)


def make_trees(rounds: int = trees.ROUNDS, leaves: int = trees.LEAVES, **settings) -> Head:
    """Boosted trees over all classes: a tree per round and class, grown best first. settings: see trees.fit."""
    def fit_models(df, models, k, seed, balanced):
        limits = trees.fit_bins(df, seed=seed)
        packed = pack(df)
        try:
            return trees.fit(packed, limits, models, k, balanced, rounds, leaves=leaves, **settings)
        finally:
            packed.release()

    return _of_models(fit_models, trees.probabilities)


def _fit_knn(train, k, seed, balanced):
    return train


def _predict_knn(train, df, k):
    return df.join(knn.knn_predict(train, df, k, NEIGHBOURS), "key")


HEADS: dict[str, Head] = {
    "linear": _of_models(_fit_linear, linear.probabilities),
    "mlp": make_mlp(),
    "trees": make_trees(),
    "lgbm": make_trees(),  # another name for "trees"
    "knn": Head(_fit_knn, _predict_knn),
}


def register_head(name: str, head: Head) -> None:
    HEADS[name] = head


def get_head(name: str | Head) -> Head:
    if isinstance(name, Head):
        return name
    if name not in HEADS:
        raise KeyError(f"unknown head {name!r}; choose from {sorted(HEADS)}")
    return HEADS[name]


def assemble_oof(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of per-fold predictions; alignment is by key, so the order of parts does not matter."""
    return reduce(DataFrame.unionByName, parts)


def cross_val_oof(df: DataFrame, head: str | Head, n_classes: int, seed: int = 42, balanced: bool = False,
                  check: bool = True, parallelism: int = 4) -> DataFrame:
    """(key, fold, label, probs): each fold predicted by a model that never saw it."""
    if head == "knn":
        oof = knn.knn_oof(df, n_classes, NEIGHBOURS)
    else:
        h, folds = get_head(head), folds_of(df)

        def one(f):
            model = h.fit(df.where(F.col("fold") != f), n_classes, seed, balanced)
            return h.predict(model, df.where(F.col("fold") == f), n_classes).select("key", "fold", "label", "probs")

        if h.fit_folds is not None:
            oof = h.predict(h.fit_folds(df, folds, n_classes, seed, balanced), df, n_classes).select("key", "fold", "label", "probs")
        else:  # each fit is a chain of short jobs; independent folds overlap
            with ThreadPoolExecutor(max_workers=parallelism) as pool:
                oof = assemble_oof(list(pool.map(inheritable_thread_target(df.sparkSession)(one), folds)))
    if check:
        assert_ok(validate_probs(oof, n_classes, expected=df))
    return oof


def fit_predict(train: DataFrame, test: DataFrame, head: str | Head, n_classes: int, seed: int = 42,
                balanced: bool = False) -> DataFrame:
    """Fit on every train row and predict the test rows."""
    h = get_head(head)
    return h.predict(h.fit(train, n_classes, seed, balanced), test, n_classes)


def probe_grid(sets: Mapping[str, DataFrame], heads: Sequence[str], n_classes: int, seed: int = 42,
               balanced: bool = True, parallelism: int = 4) -> DataFrame:
    """combo, head, mean, std, min for every vector set and head, best mean first. The fits do not depend on each other: they overlap.

    Scores are taken one at a time: each is a wide plan over n_classes^2 counts, and the driver would hold them all.
    """
    spark, scoring = next(iter(sets.values())).sparkSession, Lock()

    def one(combo, head):
        oof = with_pred(cross_val_oof(sets[combo], head, n_classes, seed, balanced, check=False))
        with scoring:
            score = fold_consistency(oof, n_classes).first()  # one row of the experiment log
        return combo, head, score["mean"], score["std"], score["min"]

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        fits = [pool.submit(inheritable_thread_target(spark)(one), combo, head) for combo in sets for head in heads]
        rows = [f.result() for f in fits]
    rows.sort(key=lambda r: (-r[2], r[0], r[1]))
    return spark.createDataFrame(rows, "combo string, head string, mean double, std double, min double")
