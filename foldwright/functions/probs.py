"""Column expressions over a probability array column with K entries.

Sums over classes are unrolled for the given K instead of using higher-order functions, so
that the expressions stay inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def entries(p: Column | str, k: int) -> list[Column]:
    """The first k entries of the array; NULL where the array is shorter."""
    return [F.get(_col(p), F.lit(i)) for i in range(k)]


def add_up(cols: list[Column]) -> Column:
    """Left-to-right sum."""
    return reduce(lambda a, b: a + b, cols)


def argmax(p: Column | str) -> Column:
    """Index of the first maximum; NaN counts as the greatest value."""
    p = _col(p)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def argmax_of(cols: list[Column]) -> Column:
    """argmax over separate columns, first maximum wins."""
    top = F.greatest(*cols)
    out = F.when(cols[0] == top, 0)
    for i, c in enumerate(cols[1:], start=1):
        out = out.when(c == top, i)
    return out.cast("int")


def top1(p: Column | str) -> Column:
    return F.array_max(_col(p))


def top2(p: Column | str) -> Column:
    return F.get(F.sort_array(_col(p), asc=False), F.lit(1))


def margin(p: Column | str) -> Column:
    return top1(p) - top2(p)


def entropy_norm(p: Column | str, k: int = 3) -> Column:
    """Natural-log entropy of the row after scaling it to sum 1; zero entries add nothing."""
    ps = entries(p, k)
    total = add_up(ps)
    terms = [F.when(x > 0, -(x / total) * F.ln(x / total)).otherwise(F.lit(0.0)) for x in ps]
    return add_up(terms)


def entropy_clip(p: Column | str, k: int = 3) -> Column:
    """Entropy with entries clipped to [1e-12, 1] and no rescaling."""
    clipped = [F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0)) for x in entries(p, k)]
    return -add_up([x * F.ln(x) for x in clipped])


def label_quality(p: Column | str, label: Column | str) -> Column:
    """Self-confidence p[label]; NULL when the label is out of range."""
    return F.get(_col(p), _col(label).cast("int"))


def scaled(p: Column | str, weights: list[float]) -> list[Column]:
    return [x * F.lit(float(w)) for x, w in zip(entries(p, len(weights)), weights)]


def scale_argmax(p: Column | str, weights: list[float]) -> Column:
    """Class after multiplying each probability by its class weight."""
    return argmax_of(scaled(p, weights))


def softmax(logits: Column | str, k: int = 3) -> Column:
    """Stable softmax as an array column."""
    xs = entries(logits, k)
    top = F.greatest(*xs)
    es = [F.exp(x - top) for x in xs]
    total = add_up(es)
    return F.array(*[e / total for e in es])


def mean_probs(arrays: list[Column | str], k: int = 3) -> Column:
    """Entry-wise mean of several probability columns."""
    cols = [entries(a, k) for a in arrays]
    return F.array(*[add_up([c[i] for c in cols]) / F.lit(float(len(arrays))) for i in range(k)])


def blend_probs(arrays: list[Column | str], weights: list[float], k: int = 3) -> Column:
    """Entry-wise weighted sum."""
    cols = [entries(a, k) for a in arrays]
    return F.array(
        *[add_up([c[i] * F.lit(float(w)) for c, w in zip(cols, weights)]) for i in range(k)]
    )


def linspace(lo: float, hi: float, n: int) -> list[float]:
    """n evenly spaced values, both ends included."""
    if n == 1:
        return [float(lo)]
    step = (hi - lo) / (n - 1)
    values = [i * step + lo for i in range(n)]
    values[-1] = float(hi)
    return values


def half_even(c: Column | str, digits: int) -> Column:
    """Round half to even, judged on the shortest decimal that names the value."""
    return F.bround(_col(c), digits)


def class_name(c: Column | str, names) -> Column:
    """Class id -> name, '?' for an unknown id."""
    c = _col(c)
    out = F.when(c == 0, names[0])
    for i, n in enumerate(names[1:], start=1):
        out = out.when(c == i, n)
    return out.otherwise("?")


def class_id(c: Column | str, names) -> Column:
    """Name -> class id, NULL for an unknown name."""
    c = _col(c)
    out = F.when(c == names[0], 0)
    for i, n in enumerate(names[1:], start=1):
        out = out.when(c == n, i)
    return out.cast("int")
