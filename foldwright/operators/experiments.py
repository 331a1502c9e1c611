"""Experiment logs as tables: best epochs, verdicts, grid winners, variant decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.operators.ordering import number_rows, ordered_chunks, running_max
from foldwright.operators.skew import lookup
from foldwright.session import freeze


def verdict(df: DataFrame, gap: float = 0.05, ceiling: float = 0.97, train: str = "train_f1",
            val: str = "val_f1") -> DataFrame:
    """underfit below the training ceiling, overfit beyond the gap, ok otherwise."""
    return df.withColumn("verdict", F.when(F.col(train) < ceiling, "underfit")
                         .when(F.col(train) - F.col(val) > gap, "overfit").otherwise("ok"))


def best_epoch(history: DataFrame, patience: int | None = None, run: Sequence[str] = ("run",),
               score: str = "val_f1") -> DataFrame:
    """Per run: best epoch and score, last epoch run, and whether patience stopped it.

    An epoch improves when its score is strictly above all earlier ones (and above 0). With
    patience, the run ends at the first epoch that many epochs after the last improvement.
    Long histories are cut into chunks, so one run may hold any share of the rows.
    """
    run = list(run)
    order = [F.asc("epoch")]
    rows = ordered_chunks(history.select(*run, "epoch", F.col(score).alias("_s")), order, run)
    rows = number_rows(rows, run, "_i", few_groups=False)
    rows = running_max(rows, order, run, F.col("_s"), "_top")
    rows = rows.withColumn("_up", F.when(F.col("_s") > F.coalesce("_top", F.lit(0.0)), F.col("_i")))
    if patience is not None:
        rows = running_max(rows, order, run, F.col("_up"), "_prev")
        waited = F.col("_i") - F.coalesce("_up", "_prev", F.lit(-1))
        rows = freeze(rows.select(*run, "epoch", "_i", "_s", "_up", waited.alias("_waited")))
        stop = rows.where(F.col("_waited") >= patience).groupBy(*run).agg(F.min("_i").alias("_stop"))
        rows = lookup(rows, stop, run)
        rows = rows.where(F.col("_stop").isNull() | (F.col("_i") <= F.col("_stop")))
    else:
        rows = rows.withColumn("_stop", F.lit(None).cast("bigint"))
    return rows.groupBy(*run).agg(
        F.max_by("epoch", "_up").alias("best_epoch"), F.coalesce(F.max_by("_s", "_up"), F.lit(0.0)).alias("best_score"),
        F.max("epoch").alias("last_epoch"), F.max("_stop").isNotNull().alias("stopped_early"))


def pick_winner(grid: DataFrame, task: Sequence[str] = (), near: float = 0.002, max_std: float | None = None,
                names: Sequence[str] = ("combo", "head")) -> DataFrame:
    """Best candidate per task: among means within `near` of the best, the highest worst fold.

    Candidates with an unstable std (above max_std) are set aside first. Two aggregations with
    map-side combine; the best mean per task is one row per task.
    """
    task = list(task)
    rows = grid if max_std is None else grid.where(F.col("std") <= max_std)
    cols = [*names, "mean", "std", "min"]
    if not task:
        top = rows.agg(F.max("mean").alias("_top")).first()["_top"]
        rows = rows.where(F.col("mean") > F.lit(top) - near) if top is not None else rows
    else:
        top = rows.groupBy(*task).agg(F.max("mean").alias("_top"))
        rows = lookup(rows, top, task)
        rows = rows.where(F.col("mean") > F.col("_top") - near)
    # Highest min, then highest mean, then the first name.
    best = rows.groupBy(*task).agg(F.min_by(
        F.struct(*cols), F.struct(-F.col("min"), -F.col("mean"), *[F.col(c) for c in names])).alias("w"))
    return best.select(*task, "w.*")


def rank_grid(grid: DataFrame, names: Sequence[str] = ("combo", "head")) -> DataFrame:
    return grid.orderBy(F.desc("mean"), *names)


def decide_variant(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Compare the variant b with the plain a: accept only if the mean rises and the worst fold does not fall."""
    on = list(on)
    rows = a.select(*on, F.col("mean").alias("mean_a"), F.col("min").alias("min_a")).join(
        b.select(*on, F.col("mean").alias("mean_b"), F.col("min").alias("min_b")), on)
    delta = F.col("mean_b") - F.col("mean_a")
    return rows.withColumn("delta", delta).withColumn(
        "decision", F.when(delta <= 0, "no_gain").when(F.col("min_b") >= F.col("min_a"), "accept")
        .otherwise("reject_overfit"))


def upsert_results(existing: DataFrame, new: DataFrame, key: str = "run_name") -> DataFrame:
    """Rows of `new` replace rows of `existing` with the same key; the others are appended."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
