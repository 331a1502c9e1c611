"""Probabilities to review log, and the finished log to the next version of the folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright import schema as S
from foldwright.operators import diagnosis, label_noise, profile, review
from foldwright.operators.validate import (
    assert_ok, combine, validate_fold_stability, validate_folds, validate_review,
)
from foldwright.session import freeze
from foldwright.sources import tables


def label_issues(probs: DataFrame, folds: DataFrame, k: int = 3, method: str = "confident_learning",
                 frac_noise: float = 0.1, margin_threshold: float = 0.15,
                 names: Sequence[str] = S.CLASS_NAMES) -> DataFrame:
    """One issue table for both methods; columns the margin method cannot fill are NULL."""
    if method == "confident_learning":
        rows = label_noise.confident_learning(probs, k, frac_noise=frac_noise, names=names)
    else:
        diag = diagnosis.diagnose(probs, k)
        rows = diagnosis.margin_issues(diag, margin_threshold).select(
            "key", "fold", "label", F.lit(None).cast("string").alias("label_name"), "pred_class",
            F.lit(None).cast("string").alias("pred_name"), F.lit(None).cast("double").alias("quality"),
            F.col("top1").alias("confidence"), "margin", "entropy", "is_high_priority")
    return label_noise.attach_metadata(rows, folds)


@dataclass
class Candidates:
    issues: DataFrame
    ambiguous: DataFrame
    merged: DataFrame
    log: DataFrame
    report: dict


def review_candidates(probs: DataFrame, folds: DataFrame, k: int = 3, pct: float = 5.0, cap_pct: float = 3.0,
                      frac_noise: float = 0.1, names: Sequence[str] = S.CLASS_NAMES,
                      pairs: Sequence[tuple[int, int]] = S.PRIORITY_PAIRS) -> Candidates:
    """Label issues and ambiguous rows, merged, ordered and turned into an empty review log."""
    # Both searches, and the quantiles behind them, take many passes over these rows.
    probs = freeze(probs)
    diag = diagnosis.diagnose(probs, k)
    issues = freeze(label_issues(probs, folds, k, frac_noise=frac_noise, names=names))
    ambiguous, report = diagnosis.ambiguous_with_cap(diag, issues, pct, cap_pct, names=names, pairs=pairs)
    # Issue rows lack the flags the order uses; derive them instead of leaving them empty.
    flagged = issues.withColumn("is_priority_pair", diagnosis.is_priority(F.col("label"), F.col("pred_class"), pairs))
    merged = review.merge_candidates(flagged, ambiguous)
    ordered = review.review_order(merged, k, names, pairs)
    return Candidates(issues, ambiguous, merged, review.init_review_log(ordered), report)


def next_version(folds: DataFrame, log: DataFrame, k: int = 3, names: Sequence[str] = S.CLASS_NAMES,
                 cap_pct: float = 3.0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(folds, class weights, one-row summary, check report) after applying a finished review log."""
    assert_ok(validate_review(log, k))
    after = freeze(review.apply_review(folds, log))
    checks = combine({"folds": validate_folds(after, k, max_share=1.01),
                      "stability": validate_fold_stability(after, folds)})
    assert_ok(checks)
    summary = review.cleaning_summary(folds, after, log, k, names, cap_pct)
    return after, profile.class_weights(after, k), summary, checks


def write_next_version(spark: SparkSession, folds_csv: str, review_csv: str, out: str, k: int = 3,
                       names: Sequence[str] = S.CLASS_NAMES, cap_pct: float = 3.0) -> dict[str, str]:
    """The same from files to files: folds CSV, class weights and a JSON summary."""
    folds, log = tables.read_folds(spark, folds_csv), tables.read_review(spark, review_csv)
    after, weights, summary, _ = next_version(folds, log, k, names, cap_pct)
    paths = {c: f"{out}/{c}" for c in ("folds_v2", "class_weights_v2", "cleaning_summary")}
    tables.export_csv(after, paths["folds_v2"], S.FOLDS_EXPORT, [F.asc("key")])
    weights.write.parquet(paths["class_weights_v2"])
    tables.write_summary(summary, paths["cleaning_summary"])
    return paths
