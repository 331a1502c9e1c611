"""Per-row diagnosis of probabilities and the filters built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions import probs as P
from foldwright.operators.order_stats import quantiles
from foldwright.operators.profile import drop_cap
from foldwright.schema import CLASS_NAMES, PRIORITY_PAIRS
from foldwright.session import freeze


def diagnose(df: DataFrame, k: int = 3, probs: str = "probs") -> DataFrame:
    """key, label, fold, pred_class, is_correct, top1, top2, margin, entropy, prob_<c>.

    A narrow projection: no shuffle, also valid on a streaming DataFrame.
    """
    return df.select(
        "key", "label", "fold",
        P.argmax(probs).alias("pred_class"),
        (F.col("label") == P.argmax(probs)).cast("int").alias("is_correct"),
        P.top1(probs).alias("top1"), P.top2(probs).alias("top2"), P.margin(probs).alias("margin"),
        P.entropy_norm(probs, k).alias("entropy"),
        *[c.alias(f"prob_{i}") for i, c in enumerate(P.entries(probs, k))],
    )


def is_priority(label: Column, pred: Column, pairs: Sequence[tuple[int, int]] = PRIORITY_PAIRS) -> Column:
    out = F.lit(False)
    for a, b in pairs:
        out = out | ((label == a) & (pred == b))
    return out


def pair_label(label: Column | str, pred: Column | str, names: Sequence[str] = CLASS_NAMES) -> Column:
    """'A→B' for a wrong prediction, 'A (correct, low margin)' otherwise."""
    label = F.col(label) if isinstance(label, str) else label
    pred = F.col(pred) if isinstance(pred, str) else pred
    a, b = P.class_name(label, names), P.class_name(pred, names)
    return F.when(label != pred, F.concat(a, F.lit("→"), b)).otherwise(
        F.concat(a, F.lit(" (correct, low margin)"))
    )


def filter_ambiguous(diag: DataFrame, margin_threshold: float | None = None,
                     entropy_threshold: float | None = None, pct: float = 5.0,
                     names: Sequence[str] = CLASS_NAMES,
                     pairs: Sequence[tuple[int, int]] = PRIORITY_PAIRS) -> tuple[DataFrame, float, float]:
    """Rows below the low margin quantile or above the high entropy quantile.

    Returns the candidates and the two thresholds used. Order them with `ambiguous_order`.
    """
    auto = {}
    if margin_threshold is None:
        auto["margin"] = [pct / 100]
    if entropy_threshold is None:
        auto["entropy"] = [(100 - pct) / 100]
    found = quantiles(diag, auto) if auto else {}
    if margin_threshold is None:
        margin_threshold = found[("margin", pct / 100)]
    if entropy_threshold is None:
        entropy_threshold = found[("entropy", (100 - pct) / 100)]
    if margin_threshold is None or entropy_threshold is None:
        margin_threshold = entropy_threshold = 0.0  # an empty table has no candidates

    low = F.col("margin") < F.lit(margin_threshold)
    high = F.col("entropy") > F.lit(entropy_threshold)
    out = diag.where(low | high).select(
        "*",
        F.when(low & high, "both").when(low, "low_margin").otherwise("high_entropy").alias("source"),
        pair_label("label", "pred_class", names).alias("pair"),
        is_priority(F.col("label"), F.col("pred_class"), pairs).alias("is_priority_pair"),
    )
    return out, margin_threshold, entropy_threshold


def ambiguous_order(df: DataFrame) -> list[Column]:
    """Double-flagged first, then priority pairs, then the smallest margin; key breaks ties."""
    order = [F.desc("is_priority_pair"), F.asc_nulls_last("margin"), F.asc("key")]
    if "is_double_flagged" in df.columns:
        order.insert(0, F.desc("is_double_flagged"))
    return order


def flag_double(candidates: DataFrame, issues: DataFrame) -> DataFrame:
    """Mark candidates that also appear among the label issues."""
    hit = issues.select("key").distinct().withColumn("_hit", F.lit(True))
    return candidates.join(hit, "key", "left").withColumn(
        "is_double_flagged", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def margin_issues(diag: DataFrame, threshold: float = 0.15, top_n: int | None = None) -> DataFrame:
    """Wrong predictions with a small margin, most doubtful first.

    `top_n` is the report size the caller asks for.
    """
    out = diag.where((F.col("is_correct") == 0) & (F.col("margin") < threshold)).select(
        "*", F.lit("wrong_prediction_low_margin").alias("source"),
        (F.col("margin") < threshold / 2).alias("is_high_priority"),
    ).orderBy("margin", "key")
    return out.limit(top_n) if top_n else out


def pair_distribution(candidates: DataFrame) -> DataFrame:
    """Per pair: count, mean margin and number of double flags, most frequent first."""
    double = (F.sum(F.col("is_double_flagged").cast("int")) if "is_double_flagged" in candidates.columns
              else F.lit(0))
    return candidates.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"), F.avg("margin").alias("margin_mean"), double.alias("double_flagged")
    ).orderBy(F.desc("n"), "pair")


def ambiguous_with_cap(diag: DataFrame, issues: DataFrame | None = None, pct: float = 5.0,
                       cap_pct: float = 3.0, total: int | None = None, **options):
    """Candidates, double flags and the size check; over the cap, once more with half the percentile.

    Returns (candidates, report) where report is a dict with the thresholds, the count, the
    percentile used and `within_cap`. The candidates are whole even when still over the cap.
    """
    total = diag.count() if total is None else total
    report = {}
    for share in (pct, pct / 2):
        rows, low, high = filter_ambiguous(diag, pct=share, **options)
        if issues is not None:
            rows = flag_double(rows, issues)
        rows = freeze(rows)  # a few percent of the table, counted here and used by the caller
        n = rows.count()
        report = {"pct": share, "margin_threshold": low, "entropy_threshold": high, "n": n,
                  "within_cap": drop_cap(n, total, cap_pct)}
        if report["within_cap"]:
            break
    return rows, report
