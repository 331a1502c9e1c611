"""Corpus to folds: list, check, fingerprint, group, split."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.operators import dedup, profile, splits
from foldwright.operators.validate import assert_ok, validate_folds
from foldwright.schema import FOLDER_LABELS
from foldwright.session import freeze
from foldwright.sources import images


@dataclass
class Corpus:
    rows: DataFrame
    skipped: DataFrame
    stats: DataFrame


def profile_corpus(spark: SparkSession, root: str, label_map: Mapping[str, int] = FOLDER_LABELS,
                   read: Callable = images.read_pixels, decoder: images.Decoder = images.decode_pixels,
                   sample_n: int | None = None) -> Corpus:
    """Readable images with label, hash and group id; the unreadable ones; one row of statistics.

    The image bytes are read and decoded once and never shuffled. For formats the JVM cannot read
    pass read=images.read_content and a decoder of your own.
    """
    content = read(spark, root)
    content = content.where(images.folder_label("path", label_map)[1].isNotNull())
    seen = freeze(images.inspect(content, decoder).select("*", *images.folder_label("path", label_map)))
    images.require_classes(seen, label_map)
    skipped = images.skip_list(seen)
    rows = seen.where("ok").select(F.col("path").alias("key"), "label_name", "label", F.col("phash").alias("hash"))
    names = [n for n, _ in sorted(label_map.items(), key=lambda x: x[1])]
    stats = profile.eda_stats(
        profile.class_distribution(rows, len(names), names),
        profile.size_summary(images.image_stats(seen, sample_n)),
        dedup.duplicate_summary(rows), skipped.count())
    return Corpus(dedup.assign_group_ids(rows), skipped, stats)


def make_folds(rows: DataFrame, k: int = 5, seed: int = 42, n_classes: int = 3, threshold: int = 0) -> DataFrame:
    """key, label, fold. Near duplicates (hash distance up to threshold) share a fold; checked before return."""
    if threshold:
        grouped = dedup.near_duplicates(rows, threshold, "components").withColumnRenamed("root", "group")
    else:
        # The hash itself names an exact group; rows without one stand alone.
        grouped = rows.withColumn("group", F.coalesce(F.col("hash").cast("string"), F.concat(F.lit("k:"), F.col("key"))))
    folds = splits.stratified_group_kfold(grouped, k, seed, n_classes).select("key", "label", "fold")
    folds = freeze(folds)
    assert_ok(validate_folds(folds, n_classes, max_share=1.01))
    return folds
