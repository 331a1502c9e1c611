"""Keyed vector tables: alignment, feature blocks, ensembles of probability sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions import probs as P
from foldwright.functions import vectors as V
from foldwright.functions.paths import normalize_path
from foldwright.operators.validate import assert_ok, report

# Column names tried, in this order, to identify a row.
KEY_NAMES = ("filepath", "path", "filename", "file", "img_path")


def common_key(left: DataFrame, right: DataFrame) -> str:
    for c in KEY_NAMES:
        if c in left.columns and c in right.columns:
            return c
    raise KeyError(f"no common key column; tried {KEY_NAMES}")


def normalize_key(df: DataFrame, column: str, name: str = "key") -> DataFrame:
    return df.withColumn(name, normalize_path(column))


def alignment_report(vecs: DataFrame, folds: DataFrame, key: str = "key") -> DataFrame:
    """Every folds key has exactly one vector. One full join, counted by case."""
    v = vecs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    both = folds.select(key, F.lit(1).alias("_f")).join(v, key, "full").agg(
        F.count_if(F.col("_f").isNotNull() & F.col("_n").isNull()).alias("missing"),
        F.count_if(F.col("_f").isNotNull() & (F.col("_n") > 1)).alias("repeated"),
        F.count_if(F.col("_f").isNull()).alias("unused"))
    return report(both, {
        "every_key_has_a_vector": F.col("missing"),
        "vector_keys_unique": F.col("repeated"),
    }, info={"vectors_without_fold_row": F.col("unused")})


def align_vectors(vecs: DataFrame, folds: DataFrame, key: str = "key", check: bool = True) -> DataFrame:
    """folds with their vectors; raises when a key has no vector or several."""
    if check:
        assert_ok(alignment_report(vecs, folds, key))
    return folds.join(vecs.select(key, "vec"), key)


def template_alignment(vecs: DataFrame, template: DataFrame, key: str = "id") -> DataFrame:
    """Template ids and vector ids must match one to one."""
    v = vecs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    both = template.select(key, F.lit(1).alias("_t")).join(v, key, "full").agg(
        F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_t").isNull()).alias("extra"),
        F.count_if(F.col("_n") > 1).alias("repeated"))
    return report(both, {"no_missing_vector": F.col("missing"), "no_extra_vector": F.col("extra"),
                         "vector_ids_unique": F.col("repeated")})


def l2_normalise(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.withColumn(vec, V.l2norm(vec))


def join_blocks(blocks: Sequence[DataFrame], key: str = "key", vec: str = "vec") -> DataFrame:
    """Feature blocks of the same rows: each normalised, then put end to end. Keys must agree."""
    parts = [b.select(key, F.col(vec).alias(f"_b{i}")) for i, b in enumerate(blocks)]
    rows = reduce(lambda a, b: a.join(b, key, "full"), parts)
    whole = F.concat(*[V.l2norm(f"_b{i}") for i in range(len(parts))])
    bad = F.raise_error(F.lit("feature blocks do not hold the same keys"))
    return rows.select(key, F.when(whole.isNull(), bad.cast("array<double>")).otherwise(whole).alias(vec))


def average_views(views: Sequence[DataFrame], key: str = "key", vec: str = "vec") -> DataFrame:
    """Mean vector over several views of the same keys. A key that a view lacks is an error."""
    names = [f"_v{i}" for i in range(len(views))]
    parts = [v.select(key, F.col(vec).alias(n)) for v, n in zip(views, names)]
    rows = reduce(lambda a, b: a.join(b, key, "full"), parts)
    return rows.select(key, _complete(names, V.vec_mean(names), key, "views").alias(vec))


def _complete(names: Sequence[str], value: Column, key: str, what: str) -> Column:
    """value; an error where one of the joined columns is missing."""
    message = F.concat(F.lit(f"{what} do not hold the same keys: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    gap = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])
    return F.when(gap, F.raise_error(message).cast("array<double>")).otherwise(value)


def normalise_weights(names: Sequence[str], weights: Mapping[str, float] | None) -> list[float]:
    """Weights scaled to sum 1; uniform by default; a missing name is an error."""
    if weights is None:
        return [1.0 / len(names)] * len(names)
    missing = [n for n in names if n not in weights]
    if missing:
        raise KeyError(f"no weight for {missing}")
    total = sum(weights[n] for n in names)
    return [weights[n] / total for n in names]


def ensemble(sets: Mapping[str, DataFrame], weights: Mapping[str, float] | None = None, k: int = 3,
             key: str = "key", probs: str = "probs") -> DataFrame:
    """(key, probs): weighted sum of probability sets joined by key; other columns come from the first.

    All sets must hold the same keys; a key that one lacks is an error.
    """
    names = list(sets)
    ws = normalise_weights(names, weights)
    first = sets[names[0]].withColumnRenamed(probs, "_p0")
    rows = reduce(
        lambda a, item: a.join(sets[item[1]].select(key, F.col(probs).alias(f"_p{item[0]}")), key, "full"),
        list(enumerate(names))[1:], first)
    cols = [f"_p{i}" for i in range(len(names))]
    return rows.withColumn(probs, _complete(cols, P.blend_probs(cols, ws, k), key, "probability sets")).drop(*cols)
