"""Column expressions over numeric vector columns (arrays of any length)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def squared_norm(v: Column | str) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x)


def l2norm(v: Column | str) -> Column:
    """Scale to unit length; a zero vector stays zero."""
    v = as_double(v)
    n = F.sqrt(squared_norm(v))
    return F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
        F.lit(0.0), lambda acc, x: acc + x,
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when a side is the zero vector."""
    n = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(n == 0, 1.0).otherwise(n))


def concat_features(blocks: list[Column | str]) -> Column:
    """Normalise every block, then put them end to end."""
    return F.concat(*[l2norm(b) for b in blocks])


def vec_sum(views: list[Column | str], weights: list[float] | None = None) -> Column:
    """Entry-wise (weighted) sum, left to right."""
    weights = weights or [1.0] * len(views)
    out = F.transform(as_double(views[0]), lambda x: x * F.lit(float(weights[0])))
    for v, w in zip(views[1:], weights[1:]):
        out = F.zip_with(out, as_double(v), _add_scaled(float(w)))
    return out


def _add_scaled(w: float):
    return lambda x, y: x + y * F.lit(w)


def vec_mean(views: list[Column | str]) -> Column:
    n = float(len(views))
    return F.transform(vec_sum(views), lambda x: x / F.lit(n))


def is_finite(v: Column | str) -> Column:
    """True when the vector holds no NULL, NaN or infinity."""
    return F.forall(
        as_double(v),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
    )
