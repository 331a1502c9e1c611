import os

import numpy as np
import pytest
from cases import prob_rows
from pyspark.sql import functions as F

from foldwright import schema as S
from foldwright.operators import heads, metrics, splits
from foldwright.operators.tuning import multiplier_grid
from foldwright.plans import clean, curate, decide
from foldwright.sources import tables


def test_curate(spark, tmp_path, make_png):
    rng = np.random.default_rng(0)
    labels = {"0_A": 0, "1_B": 1}
    for c in labels:
        os.makedirs(tmp_path / c)
        for i in range(20):
            image = rng.integers(0, 256, (24, 24))
            for name in ([f"{i}", f"{i}_copy"] if i < 4 else [f"{i}"]):
                (tmp_path / c / f"{name}.png").write_bytes(make_png(image))
    (tmp_path / "0_A" / "broken.png").write_bytes(b"\x89PNG")
    corpus = curate.profile_corpus(spark, str(tmp_path), labels)
    assert corpus.skipped.count() == 1 and corpus.rows.count() == 48
    assert corpus.rows.select("group_id").distinct().count() == 40
    s = corpus.stats.first()
    assert (s["duplicate_groups"], s["duplicate_total"], s["need_group_split"], s["n_corrupt"]) == (8, 16, True, 1)
    assert s["class_counts"] == {"0_A": 24, "1_B": 24} and s["sizes"]["width_median"] == 24
    for threshold in (0, 2):
        folds = curate.make_folds(corpus.rows, 4, n_classes=2, threshold=threshold)
        assert folds.count() == 48
        assert splits.fold_overlap(folds.join(corpus.rows.select("key", "hash"), "key"), "hash").count() == 0


def test_clean_from_files_to_files(spark, tmp_path, random_probs):
    probs = random_probs[0].withColumn("key", F.concat(F.lit("/img/"), F.col("key").cast("string")))
    folds = probs.select("key", "label", "fold")
    found = clean.review_candidates(probs, folds, cap_pct=50)
    n = found.merged.count()
    assert n == found.log.count() and found.report["within_cap"]
    assert found.log.where("decision <> 'pending'").count() == 0
    with pytest.raises(ValueError, match="no_pending"):
        clean.next_version(folds, found.log)

    done = (found.log.join(found.merged.select("key", "pred_class"), "key")
            .withColumn("decision", F.when(F.col("label_new") != F.col("pred_class"), "relabel")
                        .when(F.col("margin") < 0.01, "drop").otherwise("keep"))
            .withColumn("label_new", F.when(F.col("decision") == "relabel", F.col("pred_class")).otherwise(F.col("label_new"))))
    tables.export_csv(folds, str(tmp_path / "folds"), S.FOLDS_EXPORT)
    tables.export_csv(done, str(tmp_path / "log"), S.REVIEW_EXPORT, [F.asc("position")])
    paths = clean.write_next_version(spark, str(tmp_path / "folds"), str(tmp_path / "log"), str(tmp_path / "v2"))
    after = tables.read_folds(spark, paths["folds_v2"])
    drops = done.where("decision = 'drop'").count()
    assert after.count() == 1200 - drops
    summary = spark.read.json(paths["cleaning_summary"]).first()
    assert (summary["total_before"], summary["n_dropped"], summary["log_drops"]) == (1200, drops, drops)
    assert spark.read.parquet(paths["class_weights_v2"]).count() == 3
    changed = after.join(folds.withColumnRenamed("label", "old"), ["key", "fold"]).where("label <> old").count()
    assert changed == done.where("decision = 'relabel'").count() == summary["n_relabeled"]


def test_label_issue_fallback(random_probs):
    df = random_probs[0]
    a = clean.label_issues(df, df.select("key", "fold"))
    b = clean.label_issues(df, df.select("key", "fold"), method="margin")
    assert sorted(a.columns) == sorted(b.columns) and b.count() > 0


def test_decide(spark):
    rng = np.random.default_rng(42)
    y = np.arange(150) % 3
    x = rng.normal(0, 5, (3, 6))[y] + rng.normal(0, 1.0, (150, 6))
    rows = [(f"k{i}", i % 5, int(y[i]), x[i].tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "key string, fold int, label int, vec array<double>").cache()
    train, test = df.where("fold < 4").cache(), df.where("fold = 4").cache()
    oof = heads.cross_val_oof(train, "knn", 3)
    template = test.select(F.substring("key", 2, 9).cast("bigint").alias("pos"), F.col("key").alias("id"))
    weights = {"knn": 2.0, "linear": 1.0}
    probs = decide.refit_ensemble({"knn": (train, test, "knn"), "linear": (train, test, "linear")}, weights, 3)
    lin = heads.cross_val_oof(train, "linear", 3)
    d = decide.decide({"knn": oof, "linear": lin}, {"knn": probs, "linear": probs}, template, weights,
                      grid=multiplier_grid(steps=6), team="t", notes="n")
    assert d.submission.count() == 30 and d.nested_folds.count() == 4
    hit = d.submission.join(test, d.submission["id"] == test["key"]).where("predicted = label").count()
    assert hit / 30 > 0.9
    m = d.manifest.first()
    assert m["submission_digest"]["n_rows"] == 30 and m["active_compositions"] == ["knn", "linear"]
    assert m["ensemble_weights"] == weights and m["timestamp_utc"].endswith("Z")
    assert m["cv_estimate"]["nested_mean"] > 0.9 and list(m["multipliers"].values())[0] == 1.0
    assert sum(r["n"] for r in d.mix.collect()) == 30

    gap = template.unionByName(spark.createDataFrame([(999, "unknown")], "pos bigint, id string"))
    with pytest.raises(ValueError, match="no_nulls"):
        decide.decide({"knn": oof}, {"knn": probs}, gap, grid=multiplier_grid(steps=2))
    bad = prob_rows(spark, [(0, 0, 0, [0.9, 0.9, 0.9])])
    with pytest.raises(ValueError, match="sums_to_one"):
        decide.decide({"a": bad}, {"a": bad}, template, grid=multiplier_grid(steps=2))


def test_scores_survive_unknown_order(random_probs):
    """Shuffled parts land on the right rows because alignment is by key."""
    df = random_probs[0]
    parts = [df.where(F.col("fold") == f).orderBy(F.rand(f)) for f in (3, 1, 4, 0, 2)]
    merged = heads.assemble_oof(parts)
    assert metrics.macro_f1(metrics.with_pred(merged)).first() == metrics.macro_f1(metrics.with_pred(df)).first()
