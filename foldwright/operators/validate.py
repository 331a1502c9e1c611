"""Data checks. Each returns rows (check, ok, n_bad); assert_ok turns failures into an error.

A validator scans its table once: all rules are conditional counts in a single aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions import probs as P
from foldwright.functions import vectors as V
from foldwright.operators.single import beside
from foldwright.schema import DECISIONS


def report(row: DataFrame, bad: Mapping[str, Column], info: Mapping[str, Column] | None = None) -> DataFrame:
    """Turn a one-row table of violation counts into report rows; info rows never fail."""
    def line(name, n, ok):
        n = F.coalesce(n.cast("bigint"), F.lit(0))
        return F.struct(F.lit(name).alias("check"), (n == 0 if ok is None else F.lit(ok)).alias("ok"),
                        n.alias("n_bad"))

    lines = [line(c, n, None) for c, n in bad.items()]
    lines += [line(c, n, True) for c, n in (info or {}).items()]
    return row.select(F.inline(F.array(*lines)))


def assert_ok(checks: DataFrame) -> None:
    failed = checks.where(~F.col("ok")).collect()  # one row per rule
    if failed:
        raise ValueError("; ".join(f"{r['check']}: {r['n_bad']}" for r in failed))


def _repeated(df: DataFrame, key: str) -> DataFrame:
    """One row: number of surplus rows per repeated key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("repeated"))


def prob_rules(k: int = 3, probs: str = "probs", tol: float = 1e-3, label: bool = True) -> dict[str, Column]:
    """What is wrong with a row, by rule: conditions on the row alone, so they hold for streams as well."""
    ps = P.entries(probs, k)
    finite = F.lit(True)
    for p in ps:
        finite = finite & p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf"))
    total = P.add_up(ps)
    rules = {
        "length_k": F.coalesce(F.size(probs) != k, F.lit(True)),
        "finite": ~F.coalesce(finite, F.lit(False)),
        "sums_to_one": F.coalesce(finite, F.lit(False)) & (F.abs(total - 1) > tol + 1e-5),
    }
    if label:
        rules["label_known"] = ~F.coalesce(F.col("label").between(0, k - 1), F.lit(False))
    return rules


def vector_rules(dim: int | None = None, vec: str = "vec") -> dict[str, Column]:
    """As prob_rules, for vectors; their length only where dim is given."""
    rules = {"finite": ~F.coalesce(V.is_finite(vec), F.lit(False))}
    if dim is not None:
        rules["constant_length"] = F.coalesce(F.size(vec) != dim, F.lit(True))
    return rules


def broken_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of all rules they break in `broken`; valid on a streaming DataFrame."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("broken", names).where(F.size("broken") > 0)


def validate_probs(df: DataFrame, k: int = 3, probs: str = "probs", tol: float = 1e-3,
                   expected: DataFrame | None = None, key: str = "key") -> DataFrame:
    """Shape, finite entries, sum 1, known labels, each key once, and the keys of `expected` covered."""
    rules = {n: F.count_if(c) for n, c in prob_rules(k, probs, tol, "label" in df.columns).items()}
    row = df.agg(*[c.alias(n) for n, c in rules.items()])
    names = [*rules, "repeated"]
    if expected is None:
        row = beside(row, _repeated(df, key))
    else:
        row = beside(row, _coverage(df, expected, key))
        names += ["missing", "unexpected"]
    titles = {"repeated": "key_once", "missing": "every_key_present", "unexpected": "no_unknown_key"}
    return report(row, {titles.get(n, n): F.col(n) for n in names})


def _coverage(df: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: surplus rows, expected keys without a row, keys nobody expects. Each table is shuffled once."""
    a = df.groupBy(key).agg(F.count(F.lit(1)).alias("_a"))
    b = expected.groupBy(key).agg(F.lit(1).alias("_b"))
    return a.join(b, key, "full").agg(
        F.sum(F.col("_a") - 1).alias("repeated"),
        F.count_if(F.col("_a").isNull()).alias("missing"), F.count_if(F.col("_b").isNull()).alias("unexpected"))


def validate_vectors(df: DataFrame, n_expected: int | None = None, vec: str = "vec") -> DataFrame:
    """Row count, no NULL/NaN/infinity, one length."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(V.is_finite(vec), F.lit(False))).alias("not_finite"),
        (F.max(F.size(vec)) - F.min(F.size(vec))).alias("length_spread"))
    bad = {"finite": F.col("not_finite"), "constant_length": F.col("length_spread")}
    if n_expected is not None:
        bad["row_count"] = F.abs(F.col("n") - n_expected)
    return report(row, bad)


def validate_submission(sub: DataFrame, template: DataFrame, k: int = 3,
                        columns: Sequence[str] = ("id", "predicted")) -> DataFrame:
    """Rows, columns, order, gaps and values against the template; every rule is always evaluated.

    Both tables carry pos, which makes their row order explicit.
    """
    got = [c for c in sub.columns if c != "pos"]
    bad_columns = 0 if got == list(columns) else 1
    a = sub.select("pos", F.col("id").alias("_got"), F.col("predicted").alias("_p"), F.lit(1).alias("_a"))
    b = template.select("pos", F.col("id").alias("_want"), F.lit(1).alias("_b"))
    row = a.join(b, "pos", "full").agg(
        F.abs(F.count("_a") - F.count("_b")).alias("row_count"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_got").eqNullSafe(F.col("_want")))
        .alias("id_order"),
        F.count_if(F.col("_a").isNotNull() & (F.col("_got").isNull() | F.col("_p").isNull())).alias("no_nulls"),
        F.count_if(F.col("_p").isNotNull() & ~F.col("_p").isin(list(range(k)))).alias("known_class"))
    return report(row, {
        "row_count": F.col("row_count"), "columns": F.lit(bad_columns), "id_order": F.col("id_order"),
        "no_nulls": F.col("no_nulls"), "known_class": F.col("known_class")})


def validate_review(log: DataFrame, k: int = 3) -> DataFrame:
    """Required columns, known and final decisions, real relabels, known new labels, unique keys."""
    need = ("key", "label_old", "label_new", "decision")
    missing = [c for c in need if c not in log.columns]
    if missing:
        one = log.sparkSession.range(1)
        return report(one, {"required_columns": F.lit(len(missing))})
    known = F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False))
    row = log.agg(
        F.count_if(~known).alias("decision_known"), F.count_if(F.col("decision") == "pending").alias("no_pending"),
        F.count_if((F.col("decision") == "relabel") & F.col("label_old").eqNullSafe(F.col("label_new")))
        .alias("relabel_changes_label"),
        F.count_if(F.col("label_new").isNotNull() & ~F.col("label_new").between(0, k - 1)).alias("new_label_known"))
    row = beside(row, _repeated(log, "key"))
    return report(row, {
        "required_columns": F.lit(0), "decision_known": F.col("decision_known"), "no_pending": F.col("no_pending"),
        "relabel_changes_label": F.col("relabel_changes_label"), "new_label_known": F.col("new_label_known"),
        "key_once": F.col("repeated")})


def review_decisions(log: DataFrame) -> DataFrame:
    """One row: how many of each decision."""
    return log.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in (*DECISIONS, "pending")])


def validate_folds(folds: DataFrame, k: int = 3, max_share: float = 1.0, key: str = "key") -> DataFrame:
    """Columns, known labels, no key in two folds, no fold made of one class only."""
    missing = [c for c in (key, "label", "fold") if c not in folds.columns]
    if missing:
        return report(folds.sparkSession.range(1), {"columns": F.lit(len(missing))})
    cells = folds.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.coalesce(F.col("label").between(0, k - 1), F.lit(False))).alias("unknown"),
        *[F.count_if(F.col("label") == c).alias(f"n_{c}") for c in range(k)])
    top = F.greatest(*[F.col(f"n_{c}") for c in range(k)])
    row = cells.agg(F.sum("unknown").alias("unknown"), F.count_if(top >= F.col("n") * max_share).alias("one_class"))
    keys = folds.groupBy(key).agg(F.min("fold").alias("a"), F.max("fold").alias("b"), F.count(F.lit(1)).alias("n"))
    row = beside(row, keys.agg(F.count_if(F.col("a") != F.col("b")).alias("leaks"),
                               F.sum(F.col("n") - 1).alias("repeated")))
    return report(row, {
        "columns": F.lit(0), "label_known": F.col("unknown"), "no_fold_overlap": F.col("leaks"),
        "key_once": F.col("repeated"), "classes_in_every_fold": F.col("one_class")})


def validate_fold_stability(after: DataFrame, before: DataFrame) -> DataFrame:
    """Surviving keys keep their fold and no key is new."""
    both = after.select("key", F.col("fold").alias("_a")).join(
        before.select("key", F.col("fold").alias("_b"), F.lit(1).alias("_known")), "key", "left")
    row = both.agg(F.count_if(F.col("_a") != F.col("_b")).alias("moved"),
                   F.count_if(F.col("_known").isNull()).alias("added"))
    return report(row, {"fold_unchanged": F.col("moved"), "no_new_key": F.col("added")})


def validate_label_map(df: DataFrame, names: Sequence[str], label: str = "label", name: str = "label_name") -> DataFrame:
    """Every (id, name) pair found in the data is the agreed one."""
    good = F.coalesce(P.class_name(label, names) == F.col(name), F.lit(False))
    return report(df.agg(F.count_if(~good).alias("bad")), {"label_map": F.col("bad")})


def expect_count(df: DataFrame, n: int, name: str = "row_count") -> DataFrame:
    row = df.agg(F.abs(F.count(F.lit(1)) - n).alias("off"))
    return report(row, {name: F.col("off")})


def validate_shards(shards: DataFrame, n_expected: int) -> DataFrame:
    """Shard metadata (start, end, n_rows) must tile [0, n_expected) exactly.

    Sorted neighbours are not needed: with unique starts, a shard at 0, every other start equal
    to some end, and the right total, the shards can only form one chain.
    """
    starts = shards.groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    ends = shards.select(F.col("end").alias("start")).distinct().withColumn("_hit", F.lit(1))
    row = shards.agg(
        F.abs(F.coalesce(F.sum("n_rows"), F.lit(0)) - n_expected).alias("total"),
        F.count_if((F.col("end") - F.col("start") != F.col("n_rows")) | (F.col("n_rows") <= 0)).alias("size"),
        F.when((F.coalesce(F.min("start"), F.lit(0)) == 0) & (F.coalesce(F.max("end"), F.lit(0)) == n_expected), 0)
        .otherwise(1).alias("bounds"))
    gaps = starts.join(ends, "start", "left").agg(
        F.sum(F.col("n") - 1).alias("overlaps"),
        F.count_if((F.col("start") != 0) & F.col("_hit").isNull()).alias("gaps"))
    row = beside(row, gaps)
    return report(row, {"total_rows": F.col("total"), "rows_match_range": F.col("size"),
                        "covers_range": F.col("bounds"), "no_repeated_start": F.col("overlaps"),
                        "no_gap": F.col("gaps")})


def shard_contiguity(shards: DataFrame) -> DataFrame:
    """Each shard with `contiguous`: it starts at 0 or where another shard ends."""
    ends = shards.select(F.col("end").alias("start")).distinct().withColumn("_hit", F.lit(True))
    rows = shards.join(ends, "start", "left")
    return rows.withColumn("contiguous", (F.col("start") == 0) | F.coalesce("_hit", F.lit(False))).drop("_hit")


def validate_weights(weights: DataFrame, k: int = 3, heaviest: int | None = None) -> DataFrame:
    """K positive weights; the largest belongs to the expected rare class."""
    row = weights.agg(
        F.abs(F.count(F.lit(1)) - k).alias("n"), F.count_if(~(F.col("weight") > 0)).alias("sign"),
        F.max_by("label", F.struct("weight", -F.col("label"))).alias("top"))
    bad = {"one_per_class": F.col("n"), "positive": F.col("sign")}
    if heaviest is not None:
        bad["heaviest_class"] = (F.col("top") != heaviest).cast("int")
    return report(row, bad)


def compare_cv_oof(summary: DataFrame) -> DataFrame:
    """The mean over folds agrees with the score over all rows (see metrics.cv_summary)."""
    return report(summary, {"cv_matches_oof": (~F.col("consistent")).cast("int")})


def combine(reports: Mapping[str, DataFrame]) -> DataFrame:
    """Several reports in one, with the artefact's name in front."""
    out = None
    for name, r in reports.items():
        part = r.select(F.lit(name).alias("artefact"), "check", "ok", "n_bad")
        out = part if out is None else out.unionByName(part)
    return out
