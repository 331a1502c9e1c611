"""Confusion-based metrics.

Everything is computed from (group..., label, pred) counts: one aggregation with map-side
combine, after which at most groups x K x K rows remain. Class ids are 0..K-1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.functions.probs import add_up, argmax, class_name
from foldwright.schema import CLASS_NAMES


def classes(spark: SparkSession, k: int) -> DataFrame:
    """The class dimension, K rows."""
    return spark.range(k).select(F.col("id").cast("int").alias("label"))


def with_pred(df: DataFrame, probs: str = "probs") -> DataFrame:
    return df.withColumn("pred", argmax(probs))


def confusion_counts(df: DataFrame, group: Sequence[str] = (), label: str = "label",
                     pred: str = "pred") -> DataFrame:
    """Non-empty cells only."""
    return df.groupBy(*group, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def wide_confusion(df: DataFrame, k: int, group: Sequence[str] = (), label: str = "label",
                   pred: str = "pred", n: Column | None = None) -> DataFrame:
    """One row per group with K*K count columns c_<label>_<pred>, zeros included."""
    if n is None:  # count cells first: one counter per row instead of K x K conditions
        df, label, pred, n = confusion_counts(df, group, label, pred), "label", "pred", F.col("n")
    return df.groupBy(*group).agg(*[
        F.coalesce(F.sum(F.when((F.col(label) == i) & (F.col(pred) == j), n)), F.lit(0)).alias(f"c_{i}_{j}")
        for i in range(k) for j in range(k)
    ])


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.when(den == 0, F.lit(1)).otherwise(den))


def class_terms(k: int, i: int, cell=lambda i, j: F.col(f"c_{i}_{j}")) -> dict[str, Column]:
    """Precision, recall, F1 and counts of class i, from wide confusion columns."""
    tp = cell(i, i)
    support = add_up([cell(i, j) for j in range(k)])
    predicted = add_up([cell(j, i) for j in range(k)])
    return {
        "tp": tp, "support": support, "predicted": predicted,
        "precision": _ratio(tp, predicted), "recall": _ratio(tp, support),
        "f1": _ratio(F.lit(2) * tp, support + predicted),
    }


def macro_f1_of(k: int, cell=lambda i, j: F.col(f"c_{i}_{j}"), observed: bool = False) -> Column:
    """Mean F1 over all K classes, or only over those seen as a label or a prediction."""
    terms = [class_terms(k, i, cell) for i in range(k)]
    total = add_up([t["f1"] for t in terms])
    if not observed:
        return total / F.lit(float(k))
    seen = add_up([F.when(t["support"] + t["predicted"] > 0, F.lit(1)).otherwise(F.lit(0)) for t in terms])
    return _ratio(total, seen)


def confusion(df: DataFrame, k: int = 3, label: str = "label", pred: str = "pred") -> DataFrame:
    """K x K rows (label, pred, n), zeros included. Rows outside 0..k-1 are no cell; validate_probs reports them."""
    spark = df.sparkSession
    grid = spark.range(k * k).select(
        F.floor(F.col("id") / k).cast("int").alias("label"), (F.col("id") % k).cast("int").alias("pred")
    )
    # Only cells of the grid, so the broadcast has at most k x k rows whatever stands in the columns.
    inside = F.col(label).between(0, k - 1) & F.col(pred).between(0, k - 1)
    counts = confusion_counts(df.where(inside), (), label, pred)
    return grid.join(F.broadcast(counts), ["label", "pred"], "left").select(
        "label", "pred", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_normalised(df: DataFrame, k: int = 3, label: str = "label", pred: str = "pred") -> DataFrame:
    """Each row of the confusion matrix divided by its sum; NULL for a class with no rows."""
    row = Window.partitionBy("label")
    return confusion(df, k, label, pred).select(
        "label", "pred", F.try_divide(F.col("n"), F.sum("n").over(row)).alias("share")
    )


def per_class(df: DataFrame, k: int = 3, label: str = "label", pred: str = "pred") -> DataFrame:
    """label, precision, recall, f1, support; undefined ratios are 0."""
    wide = wide_confusion(df, k, (), label, pred)
    rows = [
        F.struct(F.lit(i).alias("label"),
                 *[class_terms(k, i)[c].alias(c) for c in ("precision", "recall", "f1", "support")])
        for i in range(k)
    ]
    return wide.select(F.inline(F.array(*rows)))


def macro_f1(df: DataFrame, k: int = 3, observed: bool = False, label: str = "label",
             pred: str = "pred") -> DataFrame:
    return wide_confusion(df, k, (), label, pred).select(macro_f1_of(k, observed=observed).alias("macro_f1"))


def classification_report(df: DataFrame, k: int = 3, names: Sequence[str] = CLASS_NAMES,
                          label: str = "label", pred: str = "pred") -> DataFrame:
    """Per-class rows, then accuracy, macro average and support-weighted average."""
    t = [class_terms(k, i) for i in range(k)]
    n = add_up([x["support"] for x in t])
    accuracy = _ratio(add_up([x["tp"] for x in t]), n)

    def line(name, precision, recall, f1, support):
        return F.struct(F.lit(name).alias("name"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1"), support.cast("bigint").alias("support"))

    def mean(m):
        return add_up([x[m] for x in t]) / F.lit(float(k))

    def weighted(m):
        return _ratio(add_up([x[m] * x["support"] for x in t]), n)

    rows = [line(names[i], x["precision"], x["recall"], x["f1"], x["support"]) for i, x in enumerate(t)]
    rows.append(line("accuracy", accuracy, accuracy, accuracy, n))
    rows.append(line("macro avg", mean("precision"), mean("recall"), mean("f1"), n))
    rows.append(line("weighted avg", weighted("precision"), weighted("recall"), weighted("f1"), n))
    return wide_confusion(df, k, (), label, pred).select(F.inline(F.array(*rows)))


def fold_scores(df: DataFrame, k: int = 3, observed: bool = False, fold: str = "fold",
                label: str = "label", pred: str = "pred") -> DataFrame:
    """fold, n, macro_f1."""
    wide = wide_confusion(df, k, (fold,), label, pred)
    n = add_up([F.col(f"c_{i}_{j}") for i in range(k) for j in range(k)])
    return wide.select(fold, n.alias("n"), macro_f1_of(k, observed=observed).alias("macro_f1"))


def fold_error_rates(df: DataFrame, k: int = 3, alert: float = 0.02) -> DataFrame:
    """Per fold: size, macro-F1 over observed classes, error rate; flag when folds differ too much.

    The spread is taken over one row per fold.
    """
    rows = fold_scores(df, k, observed=True).select(
        "fold", F.col("n").alias("n_val"), F.bround("macro_f1", 4).alias("macro_f1"),
        F.bround(F.lit(1.0) - F.col("macro_f1"), 4).alias("error_rate"),
    )
    every = Window.partitionBy(F.lit(0))
    spread = F.max("error_rate").over(every) - F.min("error_rate").over(every)
    return rows.withColumn("uneven", spread > F.lit(alert))


def fold_consistency(df: DataFrame, k: int = 3) -> DataFrame:
    """One row: mean, population std and minimum of the per-fold macro-F1."""
    return fold_scores(df, k).agg(
        F.avg("macro_f1").alias("mean"), F.stddev_pop("macro_f1").alias("std"), F.min("macro_f1").alias("min")
    )


def cv_summary(df: DataFrame, k: int = 3, tolerance: float = 0.05) -> DataFrame:
    """One row: fold mean, sample std, overall macro-F1 and whether the two agree."""
    cells = [f"c_{i}_{j}" for i in range(k) for j in range(k)]
    folds = wide_confusion(df, k, ("fold",)).withColumn("macro_f1", macro_f1_of(k))
    row = folds.agg(
        F.avg("macro_f1").alias("cv_mean"), F.stddev_samp("macro_f1").alias("cv_std"),
        *[F.sum(c).alias(c) for c in cells],
    ).withColumn("oof_overall", macro_f1_of(k))
    gap = F.abs(F.col("cv_mean") - F.col("oof_overall"))
    return row.select("cv_mean", "cv_std", "oof_overall", gap.alias("gap"), (gap < tolerance).alias("consistent"))


def fold_label_pivot(df: DataFrame, k: int = 3) -> DataFrame:
    """Fold x class counts (n_<c>) and shares (share_<c>)."""
    wide = df.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("label") == i).alias(f"n_{i}") for i in range(k)],
    )
    return wide.select("*", *[(F.col(f"n_{i}") / F.col("n")).alias(f"share_{i}") for i in range(k)])


def class_action_table(df: DataFrame, k: int = 3, target: float = 0.99,
                       names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """Per class: metrics, gap to target, most confused class (lowest id on a tie) and advice code.

    `missed_as` looks along the row (own samples lost to another class); `taken_from` looks down
    the column (other classes' samples predicted as this one).
    """
    rows = []
    for i in range(k):
        t = class_terms(k, i)
        others = [j for j in range(k) if j != i]

        def worst(cell):
            top = F.greatest(*[cell(j) for j in others]) if len(others) > 1 else cell(others[0])
            pick = F.lit(None).cast("int")
            for j in reversed(others):
                pick = F.when(cell(j) == top, j).otherwise(pick)
            return pick, top

        missed, n_missed = worst(lambda j: F.col(f"c_{i}_{j}"))
        taken, n_taken = worst(lambda j: F.col(f"c_{j}_{i}"))
        gap = F.greatest(F.lit(0.0), F.lit(target) - t["f1"])
        rows.append(F.struct(
            F.lit(i).alias("class_id"), F.lit(names[i]).alias("class_name"),
            t["precision"].alias("precision"), t["recall"].alias("recall"), t["f1"].alias("f1"),
            t["support"].alias("support"), gap.alias("gap_to_target"),
            class_name(missed, names).alias("missed_as"), n_missed.alias("n_missed"),
            class_name(taken, names).alias("taken_from"), n_taken.alias("n_taken"),
            F.when(gap == 0, "at_target")
            .when(t["recall"] < t["precision"], "low_recall_lower_threshold")
            .otherwise("low_precision_raise_threshold").alias("advice"),
        ))
    return wide_confusion(df, k).select(F.inline(F.array(*rows)))
