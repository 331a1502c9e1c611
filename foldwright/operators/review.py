"""Review loop: merge candidates, order them for people, apply their decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions.probs import class_name
from foldwright.operators.diagnosis import ambiguous_order
from foldwright.operators.ordering import rank_rows
from foldwright.operators.single import beside
from foldwright.schema import CLASS_NAMES, PRIORITY_PAIRS


def merge_candidates(issues: DataFrame, ambiguous: DataFrame, compat: bool = False) -> DataFrame:
    """Union of both candidate lists, one row per key; the issue row wins.

    Columns missing on one side are filled from the other and flags are OR-ed. With compat=True
    the winning row is kept exactly as it is, so fields only the other list has stay NULL.
    """
    both = (
        issues.drop("source").withColumn("_prio", F.lit(0)).withColumn("source", F.lit("label_issue"))
        .unionByName(
            ambiguous.withColumnRenamed("source", "ambig_source")
            .withColumn("_prio", F.lit(1)).withColumn("source", F.lit("ambiguous_filter")),
            allowMissingColumns=True,
        )
    )
    kinds = dict(both.dtypes)
    aggs = []
    for c in both.columns:
        if c in ("key", "_prio"):
            continue
        first = F.min_by(F.struct(c), "_prio")[c]  # the struct keeps a NULL of the winning row
        if compat:
            aggs.append(first.alias(c))
        elif kinds[c] == "boolean":
            aggs.append(F.coalesce(F.bool_or(c), F.lit(False)).alias(c))
        else:
            aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_prio"))).alias(c))
    return both.groupBy("key").agg(*aggs)


def review_severity(label: Column | str = "label", pred: Column | str = "pred_class",
                    margin: Column | str = "margin", doubtful: float = 0.3) -> Column:
    """mislabel, ambiguous or correct; a missing margin counts as 1."""
    label, pred, margin = (F.col(c) if isinstance(c, str) else c for c in (label, pred, margin))
    return (F.when(label != pred, "mislabel")
            .when(F.coalesce(margin, F.lit(1.0)) < doubtful, "ambiguous").otherwise("correct"))


def review_caption(csv_row: Column | str = "csv_row", label: str = "label", pred: str = "pred_class",
                   margin: str = "margin", quality: str = "quality",
                   names: Sequence[str] = CLASS_NAMES, word: str = "Baris") -> Column:
    """'[Baris 2] ✗ A→B' and a second line with margin and, if known, quality."""
    csv_row = F.col(csv_row) if isinstance(csv_row, str) else csv_row
    a, b = class_name(label, names), class_name(pred, names)
    verdict = F.when(F.col(label) == F.col(pred), F.concat(F.lit("✓ "), a)).otherwise(
        F.concat(F.lit("✗ "), a, F.lit("→"), b))
    def two_digits(c):
        return F.when(F.col(c).isNotNull() & ~F.isnan(c), F.format_string("%.2f", F.bround(c, 2)))

    score = F.coalesce(F.concat(F.lit(" Q="), two_digits(quality)), F.lit(""))
    shown = F.coalesce(two_digits(margin), F.lit("nan"))
    return F.concat(F.lit(f"[{word} "), csv_row.cast("string"), F.lit("] "), verdict,
                    F.lit("\nM="), shown, score)


def pair_ranks(k: int, names: Sequence[str], pairs: Sequence[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Priority pairs first, in their own order; the others by their written name."""
    rest = [(a, b) for a in range(k) for b in range(k) if (a, b) not in pairs]
    rest.sort(key=lambda p: f"{names[p[0]]} → {names[p[1]]}")
    return {p: i for i, p in enumerate([*pairs, *rest])}


def review_order(candidates: DataFrame, k: int = 3, names: Sequence[str] = CLASS_NAMES,
                 pairs: Sequence[tuple[int, int]] = PRIORITY_PAIRS, per_page: int = 50,
                 group_by_pair: bool = True, max_pages: int | None = None) -> DataFrame:
    """Number the candidates for review: position, csv_row, page within pair, page over all.

    Rows are ordered pair by pair; inside a pair double flags, priority and low margin come first.
    """
    rank = F.lit(0)
    if group_by_pair:
        rank = F.lit(None).cast("int")
        for (a, b), r in pair_ranks(k, names, pairs).items():
            rank = F.when((F.col("label") == a) & (F.col("pred_class") == b), r).otherwise(rank)
    rows = candidates.withColumn("pair_rank", rank).withColumn(
        "pair_key", F.concat(class_name("label", names), F.lit(" → "), class_name("pred_class", names)))
    order = ambiguous_order(rows) if "is_priority_pair" in rows.columns else [
        F.asc_nulls_last("margin"), F.asc("key")]
    rows = rank_rows(rows, order, ("pair_rank",), "in_pair")

    # At most K x K pairs: their sizes give the offset and the number of pages before each.
    sizes = sorted((r["pair_rank"], r["n"]) for r in
                   rows.groupBy("pair_rank").agg(F.count(F.lit(1)).alias("n")).collect())
    offset, page = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    before = pages = 0
    for r, n in sizes:
        offset = F.when(F.col("pair_rank") == r, before).otherwise(offset)
        page = F.when(F.col("pair_rank") == r, pages).otherwise(page)
        before += n
        pages += -(-n // per_page)
    in_page = F.floor(F.col("in_pair") / per_page)
    out = rows.withColumns({
        "position": offset + F.col("in_pair"), "csv_row": offset + F.col("in_pair") + 2,
        "page_in_pair": in_page + 1, "page": page + in_page + 1,
    })
    return out if max_pages is None else out.where(F.col("page") <= max_pages)


def init_review_log(ordered: DataFrame) -> DataFrame:
    """The empty review log: every row pending, the new label equal to the old one."""
    have = set(ordered.columns)

    def col(c, kind, default=None):
        return (F.col(c) if c in have else F.lit(default)).cast(kind).alias(c)

    return ordered.select(
        "position", "key", col("fold", "int"), F.col("label").alias("label_old"),
        F.col("label").alias("label_new"), F.lit("pending").alias("decision"),
        F.lit("").alias("reason"), F.lit("").alias("reviewer"), col("margin", "double"),
        col("quality", "double"), col("is_double_flagged", "boolean", False),
    )


def apply_review(folds: DataFrame, review: DataFrame) -> DataFrame:
    """Drop, relabel or keep rows of the folds table; survivors keep their fold.

    Both sides are unique by key (see validate_review), so the one join cannot skew.
    """
    decided = review.select("key", F.col("decision").alias("_decision"), F.col("label_new").alias("_new"))
    rows = folds.join(decided, "key", "left").where(~F.col("_decision").eqNullSafe("drop"))
    label = F.when(F.col("_decision") == "relabel", F.col("_new")).otherwise(F.col("label"))
    return rows.withColumn("label", label.cast("int")).drop("_decision", "_new")


def fold_unchanged(after: DataFrame, before: DataFrame) -> DataFrame:
    """Surviving keys whose fold differs: key, fold_before, fold_after."""
    return (
        after.select("key", F.col("fold").alias("fold_after"))
        .join(before.select("key", F.col("fold").alias("fold_before")), "key")
        .where(F.col("fold_after") != F.col("fold_before"))
    )


def cleaning_summary(before: DataFrame, after: DataFrame, review: DataFrame, k: int = 3,
                     names: Sequence[str] = CLASS_NAMES, cap_pct: float = 3.0) -> DataFrame:
    """One row: sizes before and after, decisions, drop share, class counts and weights."""
    counts = after.agg(F.count(F.lit(1)).alias("total_after"),
                       *[F.count_if(F.col("label") == i).alias(f"n_{names[i]}") for i in range(k)])
    decisions = review.agg(*[F.count_if(F.col("decision") == d).alias(a) for d, a in (
        ("drop", "log_drops"), ("relabel", "n_relabeled"), ("keep", "n_kept"))])
    total = before.agg(F.count(F.lit(1)).alias("total_before"))
    row = beside(counts, decisions, total)
    dropped = F.col("total_before") - F.col("total_after")
    weights = [F.when(F.col(f"n_{c}") > 0, F.try_divide(F.col("total_after"), k * F.col(f"n_{c}")))
               .otherwise(F.lit(float("inf"))).alias(f"weight_{c}") for c in names[:k]]
    return row.select(
        "total_before", "total_after", dropped.alias("n_dropped"), "log_drops", "n_relabeled", "n_kept",
        F.bround(dropped / F.col("total_before") * 100, 2).alias("drop_pct"),
        (dropped <= F.floor(F.col("total_before") * F.lit(cap_pct) / 100)).alias("within_cap"),
        *[f"n_{c}" for c in names[:k]], *weights,
    )


