"""Likely label errors by confident learning (Northcutt, Jiang, Chuang, JAIR 2021).

Only K thresholds, K x K joint counts and K x K cut-offs leave the executors. The rows
themselves are scanned a few times and never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions import probs as P
from foldwright.operators.order_stats import order_statistics, quantiles
from foldwright.schema import CLASS_NAMES
from foldwright.session import freeze


def class_thresholds(df: DataFrame, k: int, probs: str = "probs") -> list[float]:
    """Mean self-confidence of the rows carrying each label; infinite for an absent class."""
    ps = P.entries(probs, k)
    row = df.agg(*[F.avg(F.when(F.col("label") == i, ps[i])).alias(f"t_{i}") for i in range(k)]).first()
    return [math.inf if t is None else t for t in row]


def confident_class(thresholds: Sequence[float], probs: str = "probs") -> Column:
    """The most probable class among those reaching their threshold; NULL if none does."""
    ps = P.entries(probs, len(thresholds))
    kept = [F.when(p >= F.lit(t), p) for p, t in zip(ps, thresholds)]
    top = F.greatest(*kept)  # ignores NULLs
    out = F.lit(None).cast("int")
    for i in reversed(range(len(kept))):
        out = F.when(kept[i] == top, i).otherwise(out)
    return out


def confident_joint(df: DataFrame, k: int, probs: str = "probs") -> tuple[list[list[float]], list[int]]:
    """Counts of (label, confident class), each row scaled to the label's true count; and those counts."""
    counts = (
        df.groupBy("label", confident_class(class_thresholds(df, k, probs), probs).alias("c"))
        .agg(F.count(F.lit(1)).alias("n")).collect()
    )
    joint = [[0.0] * k for _ in range(k)]
    size = [0] * k
    for r in counts:
        if r["label"] is None or not 0 <= r["label"] < k:
            continue
        size[r["label"]] += r["n"]
        if r["c"] is not None:
            joint[r["label"]][r["c"]] += r["n"]
    for s in range(k):
        seen = sum(joint[s])
        joint[s] = [x * size[s] / seen if seen else 0.0 for x in joint[s]]
    return joint, size


def _half_even(x: float) -> int:
    return int(round(x))


def noise_quota(joint: list[list[float]], frac_noise: float) -> dict[tuple[int, int], int]:
    """How many rows labelled s look like j, for s != j; at least one row of a class is kept."""
    k = len(joint)
    out = {}
    for s in range(k):
        size = _half_even(sum(joint[s]))
        left = max(size - 1, 0)
        for j in range(k):
            if j != s:
                n = min(_half_even(frac_noise * joint[s][j]), left)
                left -= n
                if n > 0:
                    out[(s, j)] = n
    return out


def _cuts(df: DataFrame, k: int, quota: dict[tuple[int, int], int], sizes: list[int],
          probs: str) -> dict[tuple[int, int], float]:
    """Per (s, j) the quota-th largest p_j - p_s; per (s, s) the quota-th smallest self-confidence, negated.

    Group s * K + j; all groups are searched in the same passes.
    """
    ps, quality = P.entries(probs, k), P.label_quality(probs, "label")
    cells = []
    for j in range(k):
        gap = F.when(F.col("label") == j, -quality).otherwise(ps[j] - quality)
        cells.append(F.struct((F.col("label") * k + j).alias("g"), gap.alias("v")))
    wanted = {s * k + j: [sizes[s] - min(n, sizes[s])] for (s, j), n in quota.items() if sizes[s] and n > 0}
    if not wanted:
        return {}
    rows = df.select(F.inline(F.array(*cells))).where(F.col("g").isin(list(wanted)))
    at = order_statistics(rows, "v", wanted, by=F.col("g"), around=(-1.0, 1.0))
    return {divmod(g, k): v for (g, _), v in at.items()}


def confident_learning(df: DataFrame, k: int = 3, filter_by: str = "prune_by_noise_rate",
                       frac_noise: float = 0.1, probs: str = "probs",
                       names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """Rows likely to carry a wrong label, with quality, confidence, margin and priority flag.

    prune_by_noise_rate: for each pair (s, j) the rows labelled s with the largest p_j - p_s,
    as many as the joint suggests; rows equal to the last one count as well.
    both: those rows that are also among the least self-confident of their class.
    A row whose most probable class is its label is never an issue.
    """
    if filter_by not in ("prune_by_noise_rate", "both"):
        raise ValueError(f"unknown filter {filter_by!r}")
    joint, sizes = confident_joint(df, k, probs)
    quota = noise_quota(joint, frac_noise)
    if filter_by == "both":
        quota.update({(s, s): sum(n for (a, _), n in quota.items() if a == s) for s in range(k)})
    cuts = _cuts(df, k, quota, sizes, probs)
    ps = P.entries(probs, k)
    label, quality = F.col("label"), P.label_quality(probs, "label")
    hit, low = F.lit(False), F.lit(False)
    for (s, j), cut in sorted(cuts.items()):
        if s == j:
            low = low | ((label == s) & (-quality >= F.lit(cut)))
        else:
            hit = hit | ((label == s) & (ps[j] - quality >= F.lit(cut)))
    if filter_by == "both":
        hit = hit & low

    issues = df.where(hit & (P.argmax(probs) != label)).select(
        "key", "fold", "label", P.class_name("label", names).alias("label_name"),
        P.argmax(probs).alias("pred_class"), P.class_name(P.argmax(probs), names).alias("pred_name"),
        quality.alias("quality"), P.top1(probs).alias("confidence"), P.margin(probs).alias("margin"),
        P.entropy_norm(probs, k).alias("entropy"),
    )
    return flag_high_priority(freeze(issues))  # few rows; the quantile takes several passes


def flag_high_priority(issues: DataFrame, q: float = 0.25) -> DataFrame:
    """Mark the quarter of the issues with the lowest quality (ties at the quantile included)."""
    cut = quantiles(issues, {"quality": [q]})[("quality", q)]
    return issues.withColumn("is_high_priority", F.lit(False) if cut is None else F.col("quality") <= F.lit(cut))


def attach_metadata(issues: DataFrame, folds: DataFrame, columns: Sequence[str] = ("fold",)) -> DataFrame:
    """Add columns of the folds table to issues by key. An issue without a row there is an error."""
    rows = issues.drop(*[c for c in columns if c in issues.columns]).join(
        folds.select("key", *columns, F.lit(True).alias("_known")), "key", "left")
    lost = F.raise_error(F.concat(F.lit("no metadata for issue "), F.coalesce(F.col("key").cast("string"), F.lit("NULL"))))
    kind = dict(rows.dtypes)["key"]
    return rows.withColumn("key", F.when(F.col("_known"), F.col("key")).otherwise(lost.cast(kind))).drop("_known")
