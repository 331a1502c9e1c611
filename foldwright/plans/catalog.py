"""Registered queries over a data folder, each with an equivalent SQL text where SQL can say it.

Every query works on whole tables. Doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright import schema
from foldwright.functions import paths as PATH
from foldwright.functions import probs as P
from foldwright.functions import vectors as V
from foldwright.operators import (
    ann, dedup, diagnosis, experiments, heads, knn, label_noise, metrics, profile, review, splits, tuning, validate, vectors,
)
from foldwright.operators.order_stats import quantiles
from foldwright.operators.single import beside
from foldwright.plans import clean, decide, inputs, twins
from foldwright.session import ensure_checkpoint_dir, freeze
from foldwright.sources import images, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _scored(spark, sf):
    return metrics.with_pred(inputs.prob_table(spark, sf))


# --- profile -------------------------------------------------------------------------------

@query("class_distribution", twins.class_distribution())
def class_distribution(spark, sf):
    return rounded(profile.class_distribution(inputs.prob_table(spark, sf)))


@query("class_weights", twins.class_weights())
def class_weights(spark, sf):
    return rounded(profile.class_weights(inputs.prob_table(spark, sf)))


@query("prediction_mix", twins.prediction_mix())
def prediction_mix(spark, sf):
    return rounded(profile.prediction_mix(_scored(spark, sf), pred="pred"))


@query("size_summary", twins.size_summary())
def size_summary(spark, sf):
    docs = inputs.document_table(spark, sf).select(
        F.col("n_chars").alias("width"), F.size(F.split("text", "\n")).alias("height"), F.col("lang").alias("channels"))
    return profile.size_summary(docs)


@query("histogram_margin", twins.histogram("margin", 60))
def histogram_margin(spark, sf):
    return rounded(profile.histogram(diagnosis.diagnose(inputs.prob_table(spark, sf)), "margin", 60, "label"))


@query("histogram_sizes", twins.HISTOGRAM_SIZES)
def histogram_sizes(spark, sf):
    return rounded(profile.histogram(inputs.table(spark, sf, "documents"), "n_chars", 40))


@query("content_hash", twins.CONTENT_HASH)
def content_hash(spark, sf):
    docs = inputs.table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("key"), PATH.short_digest("text").alias("digest"))


@query("table_digest", twins.TABLE_DIGEST)
def table_digest(spark, sf):
    labels = inputs.table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return profile.table_digest(labels).drop("schema_digest")


@query("eda_stats", twins.eda_stats())
def eda_stats(spark, sf):
    """The nested profile row, its parts as columns."""
    docs = inputs.document_table(spark, sf)
    sizes = size_summary(spark, sf)
    dist = profile.class_distribution(inputs.labelled_documents(spark, sf), 2, ["low", "high"])
    row = profile.eda_stats(dist, sizes, dedup.duplicate_summary(docs))
    counts, ratios = F.col("class_counts"), F.col("class_ratios")
    return rounded(row.select(
        counts["low"].alias("n_low"), counts["high"].alias("n_high"), ratios["low"].alias("share_low"),
        ratios["high"].alias("share_high"), "sizes.*", "duplicate_groups", "duplicate_total", "need_group_split", "n_corrupt"))


# --- metrics -------------------------------------------------------------------------------

@query("confusion", twins.confusion())
def confusion(spark, sf):
    return metrics.confusion(_scored(spark, sf))


@query("confusion_norm", twins.confusion_norm())
def confusion_norm(spark, sf):
    return rounded(metrics.confusion_normalised(_scored(spark, sf)))


@query("prf_support", twins.prf_support())
def prf_support(spark, sf):
    return rounded(metrics.per_class(_scored(spark, sf)))


@query("macro_f1_fixed", twins.macro_f1())
def macro_f1_fixed(spark, sf):
    return rounded(metrics.macro_f1(_scored(spark, sf)))


@query("macro_f1_observed", twins.macro_f1(k=4, observed=True))
def macro_f1_observed(spark, sf):
    return rounded(metrics.macro_f1(_scored(spark, sf), 4, observed=True))


@query("classification_report", twins.classification_report())
def classification_report(spark, sf):
    return rounded(metrics.classification_report(_scored(spark, sf)))


@query("fold_error_rates", twins.fold_error_rates())
def fold_error_rates(spark, sf):
    return metrics.fold_error_rates(_scored(spark, sf))


@query("fold_consistency", twins.fold_consistency())
def fold_consistency(spark, sf):
    return rounded(metrics.fold_consistency(_scored(spark, sf)))


@query("cv_summary", twins.cv_summary())
def cv_summary(spark, sf):
    return rounded(metrics.cv_summary(_scored(spark, sf)))


@query("fold_scores", twins.fold_scores())
def fold_scores(spark, sf):
    return rounded(metrics.fold_scores(_scored(spark, sf)))


@query("fold_label_pivot", twins.fold_label_pivot())
def fold_label_pivot(spark, sf):
    return rounded(metrics.fold_label_pivot(inputs.prob_table(spark, sf)))


@query("class_action_table", twins.class_action_table())
def class_action_table(spark, sf):
    return rounded(metrics.class_action_table(_scored(spark, sf)))


# --- row functions --------------------------------------------------------------------------

@query("diagnose", twins.diagnose())
def diagnose(spark, sf):
    return rounded(diagnosis.diagnose(inputs.prob_table(spark, sf)))


@query("entropy_clip", twins.entropy_clip())
def entropy_clip(spark, sf):
    return rounded(inputs.prob_table(spark, sf).select("key", P.entropy_clip("probs").alias("entropy")))


@query("label_quality", twins.label_quality())
def label_quality(spark, sf):
    return rounded(inputs.prob_table(spark, sf).select("key", P.label_quality("probs", "label").alias("quality")))


@query("softmax", twins.softmax())
def softmax(spark, sf):
    rows = inputs.prob_table(spark, sf).select("key", P.softmax("probs").alias("s"))
    return rounded(rows.select("key", *[c.alias(f"s{i}") for i, c in enumerate(P.entries("s", 3))]))


@query("mean_probs", twins.mean_probs())
def mean_probs(spark, sf):
    a, b = inputs.prob_table(spark, sf), inputs.second_prob_table(spark, sf)
    rows = a.select("key", F.col("probs").alias("a")).join(b.select("key", F.col("probs").alias("b")), "key")
    rows = rows.select("key", P.mean_probs(["a", "b"]).alias("m"))
    return rounded(rows.select("key", *[c.alias(f"m{i}") for i, c in enumerate(P.entries("m", 3))]))


@query("apply_multipliers", twins.apply_multipliers([1.0, 1.25, 0.9]))
def apply_multipliers(spark, sf):
    return tuning.apply_multipliers(inputs.prob_table(spark, sf), [1.0, 1.25, 0.9]).select("key", "predicted")


@query("quantiles", twins.quantiles())
def margin_quantiles(spark, sf):
    diag = diagnosis.diagnose(inputs.prob_table(spark, sf))
    qs = [0.05, 0.25, 0.5, 0.95]
    at = quantiles(diag, {"margin": qs})
    return rounded(diag.agg(F.min("margin").alias("p0"), F.max("margin").alias("p100"),
                            *[F.lit(at[("margin", q)]).alias(f"p{round(q * 100)}") for q in qs]))


@query("normalize_path", twins.NORMALIZE_PATH)
def normalize_path(spark, sf):
    pages = inputs.table(spark, sf, "pages")
    raw = F.concat(F.lit("/data//"), F.substring_index("url", "://", -1), F.lit("/./x/../img.png"))
    return pages.select("page_id", PATH.normalize_path(raw).alias("path"))


@query("rebase_paths", twins.REBASE_PATHS)
def rebase_paths(spark, sf):
    pages = inputs.table(spark, sf, "pages")
    return pages.select("page_id", PATH.rebase(F.concat(F.lit("/drive/train/"), F.substring_index("url", "://", -1)),
                                               "/drive/train", "/local/cache").alias("path"))


@query("label_names", twins.LABEL_NAMES)
def label_names(spark, sf):
    names = ["F", "O", "P"]
    orders = inputs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), P.class_id("o_orderstatus", names)
                                                      .alias("label"))
    return orders.select("key", "label", P.class_name("label", names).alias("label_name"))


@query("hex_bits", twins.HEX_BITS)
def hex_bits(spark, sf):
    docs = inputs.table(spark, sf, "documents")
    word = PATH.hex_to_bits(F.substring(F.md5("text"), 1, 16))
    return docs.select(F.col("doc_id").alias("key"), PATH.bits_to_hex(word).alias("hex"),
                       F.bit_count(word).alias("bits"))


# --- ambiguity and label noise ---------------------------------------------------------------

def _ambiguous(spark, sf):
    return diagnosis.filter_ambiguous(diagnosis.diagnose(inputs.prob_table(spark, sf)))[0]


def _issues(spark, sf, filter_by="prune_by_noise_rate"):
    return label_noise.confident_learning(inputs.prob_table(spark, sf), filter_by=filter_by)


@query("ambiguous", twins.ambiguous())
def ambiguous(spark, sf):
    return rounded(_ambiguous(spark, sf).select(
        "key", "fold", "label", "pred_class", "margin", "entropy", "top1", "top2", "pair", "is_priority_pair", "source"))


@query("margin_issues", twins.margin_issues())
def margin_issues(spark, sf):
    rows = diagnosis.margin_issues(diagnosis.diagnose(inputs.prob_table(spark, sf)))
    return rounded(rows.select("key", "fold", "label", "pred_class", "margin", "source", "is_high_priority"))


@query("margin_issues_top", twins.margin_issues(top_n=50))
def margin_issues_top(spark, sf):
    rows = diagnosis.margin_issues(diagnosis.diagnose(inputs.prob_table(spark, sf)), top_n=50)
    return rounded(rows.select("key", "fold", "label", "pred_class", "margin", "source", "is_high_priority"))


_ISSUE_COLUMNS = ["key", "fold", "label", "label_name", "pred_class", "pred_name", "quality", "confidence", "margin",
                  "entropy", "is_high_priority"]


@query("confident_learning", twins.confident_learning())
def confident_learning(spark, sf):
    return rounded(_issues(spark, sf).select(*_ISSUE_COLUMNS))


@query("confident_learning_both", twins.confident_learning(both=True))
def confident_learning_both(spark, sf):
    return rounded(_issues(spark, sf, "both").select(*_ISSUE_COLUMNS))


@query("label_issues", twins.confident_learning())
def label_issues(spark, sf):
    probs = inputs.prob_table(spark, sf)
    return rounded(clean.label_issues(probs, probs.select("key", "label", "fold")).select(*_ISSUE_COLUMNS))


@query("double_flag", twins.double_flag())
def double_flag(spark, sf):
    rows = diagnosis.flag_double(_ambiguous(spark, sf), _issues(spark, sf))
    return rows.select("key", "is_priority_pair", "is_double_flagged")


@query("pair_distribution", twins.pair_distribution())
def pair_distribution(spark, sf):
    return rounded(diagnosis.pair_distribution(diagnosis.flag_double(_ambiguous(spark, sf), _issues(spark, sf))))


@query("ambiguous_with_cap", twins.ambiguous_with_cap())
def ambiguous_with_cap(spark, sf):
    return rounded(diagnosis.ambiguous_with_cap(diagnosis.diagnose(inputs.prob_table(spark, sf)))[0].select(
        "key", "label", "pred_class", "margin", "entropy", "source"))


# --- review loop -----------------------------------------------------------------------------

def _merged(spark, sf):
    issues = freeze(_issues(spark, sf))
    flagged = issues.withColumn("is_priority_pair", diagnosis.is_priority(F.col("label"), F.col("pred_class")))
    return review.merge_candidates(flagged, diagnosis.flag_double(_ambiguous(spark, sf), issues))


def _review(spark, sf):
    """A finished log: urgent issues are dropped, other issues relabelled, the rest kept."""
    rows = _merged(spark, sf)
    decision = (F.when(F.col("is_high_priority"), "drop").when(F.col("source") == "label_issue", "relabel")
                .otherwise("keep"))
    return rows.select("key", "fold", F.col("label").alias("label_old"), decision.alias("decision"),
                       F.when(decision == "relabel", F.col("pred_class")).otherwise(F.col("label")).alias("label_new"))


@query("merge_candidates", twins.merge_candidates())
def merge_candidates(spark, sf):
    return rounded(_merged(spark, sf).select(
        "key", "fold", "label", "pred_class", "source", "margin", "entropy", "quality", "ambig_source",
        "is_priority_pair", "is_double_flagged", "is_high_priority"))


@query("merge_candidates_compat", twins.merge_candidates(compat=True))
def merge_candidates_compat(spark, sf):
    issues = freeze(_issues(spark, sf))
    rows = review.merge_candidates(issues, diagnosis.flag_double(_ambiguous(spark, sf), issues), compat=True)
    return rounded(rows.select("key", "source", "margin", "quality", "ambig_source", "is_priority_pair",
                               "is_double_flagged", "is_high_priority"))


@query("review_order", twins.review_order())
def review_order(spark, sf):
    rows = review.review_order(_merged(spark, sf))
    return rows.select("key", "pair_key", "position", "csv_row", "page_in_pair", "page")


@query("review_log", twins.review_log())
def review_log(spark, sf):
    return rounded(review.init_review_log(review.review_order(_merged(spark, sf))))


@query("review_caption", twins.review_caption())
def review_caption(spark, sf):
    rows = review.review_order(_merged(spark, sf))
    return rows.select("key", review.review_caption().alias("caption"), review.review_severity().alias("severity"))


@query("validate_review", twins.validate_review())
def validate_review(spark, sf):
    return validate.validate_review(_review(spark, sf))


@query("review_decisions", twins.review_decisions())
def review_decisions(spark, sf):
    return validate.review_decisions(_review(spark, sf))


def _folds(spark, sf):
    return inputs.prob_table(spark, sf).select("key", "label", "fold")


@query("apply_review", twins.apply_review())
def apply_review(spark, sf):
    return review.apply_review(_folds(spark, sf), _review(spark, sf))


@query("cleaning_summary", twins.cleaning_summary())
def cleaning_summary(spark, sf):
    return rounded(clean.next_version(_folds(spark, sf), freeze(_review(spark, sf)))[2])


@query("class_weights_v2", twins.class_weights_v2())
def class_weights_v2(spark, sf):
    return rounded(clean.next_version(_folds(spark, sf), freeze(_review(spark, sf)))[1])


@query("fold_unchanged", twins.FOLD_UNCHANGED)
def fold_unchanged(spark, sf):
    after = _folds(spark, sf).withColumn("fold", F.when(F.col("label") == 2, (F.col("fold") + 1) % 5)
                                         .otherwise(F.col("fold")))
    return review.fold_unchanged(after, _folds(spark, sf))


@query("validate_fold_stability", twins.VALIDATE_FOLD_STABILITY)
def validate_fold_stability(spark, sf):
    after = _folds(spark, sf).withColumn("fold", F.when(F.col("label") == 2, (F.col("fold") + 1) % 5)
                                         .otherwise(F.col("fold")))
    return validate.validate_fold_stability(after, _folds(spark, sf))


# --- duplicates and splits --------------------------------------------------------------------

@query("duplicate_groups", twins.DUPLICATE_GROUPS)
def duplicate_groups(spark, sf):
    return dedup.duplicate_groups(inputs.document_table(spark, sf))


@query("duplicate_members", twins.DUPLICATE_MEMBERS)
def duplicate_members(spark, sf):
    return dedup.duplicate_members(inputs.document_table(spark, sf))


@query("duplicate_summary", twins.DUPLICATE_SUMMARY)
def duplicate_summary(spark, sf):
    return dedup.duplicate_summary(inputs.document_table(spark, sf))


@query("group_ids", twins.GROUP_IDS)
def group_ids(spark, sf):
    rows = inputs.document_table(spark, sf).select("key", "hash")
    return dedup.assign_group_ids(rows).select("key", "group_id")


@query("near_duplicates", twins.STAR)
def near_duplicates(spark, sf):
    return dedup.near_duplicates(inputs.hash_table(spark, sf), 2, "star").select("key", "root")


@query("near_duplicate_components", twins.COMPONENTS)
def near_duplicate_components(spark, sf):
    return dedup.near_duplicates(inputs.hash_table(spark, sf), 2, "components").select("key", "root")


@query("near_duplicate_groups", twins.COMPONENT_GROUPS)
def near_duplicate_groups(spark, sf):
    return dedup.near_duplicate_groups(inputs.hash_table(spark, sf), 2, "components")


@query("stratified_kfold", twins.stratified_kfold())
def stratified_kfold(spark, sf):
    return splits.stratified_kfold(_folds(spark, sf).drop("fold")).select("key", "label", "fold")


@query("stratified_group_kfold", twins.STRATIFIED_GROUP_KFOLD)
def stratified_group_kfold(spark, sf):
    return splits.stratified_group_kfold(inputs.labelled_documents(spark, sf), n_classes=2).select("key", "label", "group", "fold")


@query("group_kfold_leaks", "SELECT CAST(0 AS BIGINT) AS n_leaks, count(*) AS n_rows FROM labels")
def group_kfold_leaks(spark, sf):
    folds = splits.stratified_group_kfold(inputs.labelled_documents(spark, sf), n_classes=2)
    leaks = splits.fold_overlap(folds, "group")
    return leaks.agg(F.count(F.lit(1)).alias("n_leaks")).withColumn("n_rows", F.lit(folds.count()))


@query("split_fold", twins.split_fold())
def split_fold(spark, sf):
    train, val = splits.split_fold(_folds(spark, sf), 3)
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val"))).groupBy(
        "part", "label").agg(F.count(F.lit(1)).alias("n"))


@query("exclude", twins.EXCLUDE)
def exclude(spark, sf):
    docs = inputs.document_table(spark, sf).select("key", "source")
    skip = inputs.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("key"))
    return splits.exclude(docs, skip)


@query("fold_overlap", twins.FOLD_OVERLAP)
def fold_overlap(spark, sf):
    li = inputs.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("fold"))
    return splits.fold_overlap(li)


@query("sample_per_class", twins.sample_per_class())
def sample_per_class(spark, sf):
    return splits.sample_per_class(_folds(spark, sf), 5).select("key", "label")


@query("validate_folds", twins.VALIDATE_FOLDS)
def validate_folds(spark, sf):
    li = inputs.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("fold"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"))
    return validate.validate_folds(li)


# --- vectors and heads -------------------------------------------------------------------------

def _spread(df: DataFrame, name: str = "vec", first: int = 4) -> DataFrame:
    """A vector as a few plain columns: leading entries, length and squared norm."""
    return df.select("key", F.size(name).alias("dim"), F.round(V.squared_norm(name), 6).alias("norm2"),
                     *[F.round(F.get(name, F.lit(i)), 6).alias(f"v{i}") for i in range(first)])


@query("l2norm", twins.L2NORM)
def l2norm(spark, sf):
    vecs = inputs.vector_table(spark, sf).withColumn("vec", F.transform("vec", lambda x: x.cast("double") * 3 + 1))
    return _spread(vectors.l2_normalise(vecs))


@query("concat_features", twins.CONCAT_FEATURES)
def concat_features(spark, sf):
    a = inputs.vector_table(spark, sf).select("key", "vec")
    b = a.withColumn("vec", F.transform("vec", lambda x: x.cast("double") * 1000 + 1))
    rows = vectors.join_blocks([a, b])
    return rows.select("key", F.size("vec").alias("dim"), F.round(V.squared_norm("vec"), 6).alias("norm2"),
                       F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.round(F.get("vec", F.lit(64)), 6).alias("mid"))


@query("vec_mean", twins.VEC_MEAN)
def vec_mean(spark, sf):
    a = inputs.vector_table(spark, sf).select("key", "vec")
    return _spread(vectors.average_views([a, a.withColumn("vec", F.reverse("vec"))]))


@query("cosine", twins.COSINE)
def cosine(spark, sf):
    vecs = inputs.vector_table(spark, sf)
    return vecs.select("key", F.round(V.cosine("vec", F.reverse("vec")), 6).alias("similarity"))


@query("align_vectors", twins.ALIGN_VECTORS)
def align_vectors(spark, sf):
    vecs = inputs.vector_table(spark, sf)
    folds = vecs.where("label <> 9").select("key", "fold", "label")
    rows = vectors.align_vectors(vecs.select("key", "vec"), folds)
    return rows.select("key", "fold", "label", F.size("vec").alias("dim"))


@query("alignment_report", twins.ALIGNMENT_REPORT)
def alignment_report(spark, sf):
    docs = inputs.document_table(spark, sf).select("key")
    return vectors.alignment_report(inputs.vector_table(spark, sf).select("key", "vec"), docs)


@query("validate_vectors", twins.VALIDATE_VECTORS)
def validate_vectors(spark, sf):
    vecs = inputs.vector_table(spark, sf).withColumn(
        "vec", F.when(F.col("label") == 0, F.concat("vec", F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("vec")))
    return validate.validate_vectors(vecs, vecs.count() + 1)


@query("knn_join", twins.knn_join())
def knn_join(spark, sf):
    vecs = inputs.vector_table(spark, sf)
    return rounded(knn.knn_join(vecs, vecs, 15, exclude_same_fold=True).select("q_key", "t_key", "t_label", "dist"))


@query("knn_join_cells", twins.knn_join())
def knn_join_cells(spark, sf):
    """The plan for train tables above one block: pivots, cells and paired blocks."""
    vecs = inputs.vector_table(spark, sf)
    return rounded(knn.knn_join(vecs, vecs, 15, block_rows=64, exclude_same_fold=True).select("q_key", "t_key", "t_label", "dist"))


@query("knn_oof_cells", twins.knn_oof())
def knn_oof_cells(spark, sf):
    rows = knn.knn_oof(inputs.vector_table(spark, sf), 10, block_rows=64)
    return rounded(rows.select("key", "fold", "label", *[F.get("probs", F.lit(i)).alias(f"p{i}") for i in range(10)]))


def _approximate(spark, sf):
    """The given vectors searched for 15 neighbours in other folds: shares of exact rows, hits, reach and scanned codes."""
    vecs = freeze(inputs.vector_table(spark, sf))
    near, reach, scanned = ann.ann_search(vecs, vecs, 15, 0.9, exclude_same_fold=True)
    exact = knn.knn_join(vecs, vecs, 15, exclude_same_fold=True).select("q_key", "t_key")
    hits = exact.join(near.select("q_key", "t_key", F.lit(1).alias("found")), ["q_key", "t_key"], "left")
    found = F.sum(F.coalesce("found", F.lit(0))) / F.count(F.lit(1))
    return hits.agg(F.count_distinct("q_key").alias("queries"), F.count(F.lit(1)).alias("neighbours"), found.alias("recall")), reach, scanned


@query("knn_recall", """SELECT count(*) AS queries, sum(least(15, usable)) AS neighbours, true AS recall_at_least_90 FROM (
  SELECT n - count(*) OVER (PARTITION BY vec_id % 5) AS usable FROM embeddings, (SELECT count(*) AS n FROM embeddings))""")
def knn_recall(spark, sf):
    """The approximate search finds at least nine tenths of the exact neighbours of the vectors as they are."""
    measured, _, _ = _approximate(spark, sf)
    return measured.select("queries", "neighbours", (F.col("recall") >= 0.9).alias("recall_at_least_90"))


@query("knn_search_work")
def knn_search_work(spark, sf):
    """Its measured recall as a number, and what it takes: cells, candidates, share of all pairs ranked by code and by distance."""
    measured, reach, scanned = _approximate(spark, sf)
    work = scanned.agg(F.avg("scanned").alias("codes"), F.count(F.lit(1)).alias("rows"))
    return beside(measured, work).select(
        "queries", F.round("recall", 4).alias("recall"), F.lit(reach.cells).alias("cells"), F.lit(reach.candidates).alias("candidates"),
        F.round(F.col("codes") / F.col("rows"), 4).alias("share_by_code"), F.round(reach.candidates / F.col("rows"), 4).alias("share_by_distance"))


@query("knn_oof", twins.knn_oof())
def knn_oof(spark, sf):
    rows = knn.knn_oof(inputs.vector_table(spark, sf), 10)
    return rounded(rows.select("key", "fold", "label", *[F.get("probs", F.lit(i)).alias(f"p{i}") for i in range(10)]))


def _features(spark, sf):
    """Second probability set of the orders as a three-entry feature vector."""
    return inputs.second_prob_table(spark, sf).withColumnRenamed("probs", "vec")


def _prediction_facts(rows: DataFrame, k: int = 3) -> DataFrame:
    """Per fold what holds for any sound head: every key once, sums of 1, better than the commonest class."""
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    hit = (P.argmax("probs") == F.col("label")).cast("int")
    shares = [F.sum((F.col("label") == c).cast("int")) for c in range(k)]
    return rows.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("key").alias("n_keys"),
        F.bool_and((F.size("probs") == k) & (F.abs(total - 1) < 1e-6)).alias("sums_to_one"),
        (F.sum(hit) > F.greatest(*shares)).alias("beats_commonest"))


_FACTS = """SELECT CAST(o_orderkey % 5 AS INT) AS fold, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys,
  true AS sums_to_one, true AS beats_commonest FROM orders {where} GROUP BY 1"""
_FIRST_FOLD = _FACTS.format(where="WHERE o_orderkey % 5 = 0")


def _fitted(spark, sf, head, balanced=False):
    """The first fold predicted by a head fitted on all others."""
    train, test = splits.split_fold(_features(spark, sf), 0)
    return _prediction_facts(heads.fit_predict(freeze(train), test, head, 3, balanced=balanced))


@query("linear_oof", _FACTS.format(where=""))
def linear_oof(spark, sf):
    return _prediction_facts(heads.cross_val_oof(freeze(_features(spark, sf)), "linear", 3, balanced=True))


@query("linear_predict", _FIRST_FOLD)
def linear_predict(spark, sf):
    return _fitted(spark, sf, "linear")


@query("mlp_predict", _FIRST_FOLD)
def mlp_predict(spark, sf):
    return _fitted(spark, sf, "mlp")


@query("trees_predict", _FIRST_FOLD)
def trees_predict(spark, sf):
    return _fitted(spark, sf, "trees")


@query("probe_grid", """SELECT unnest(['joined', 'joined', 'plain', 'plain', 'plain', 'plain', 'unit', 'unit', 'unit', 'unit']) AS combo,
  unnest(['linear', 'mlp', 'knn', 'lgbm', 'linear', 'mlp', 'knn', 'lgbm', 'linear', 'mlp']) AS head, true AS in_range""")
def probe_grid(spark, sf):
    """Two vector sets with all four heads, and their concatenation with the linear and the neural one, at full settings."""
    vecs = freeze(inputs.vector_table(spark, sf))
    unit = freeze(vectors.l2_normalise(vecs))
    joined = freeze(vectors.join_blocks([vecs.select("key", "vec"), unit.select("key", F.reverse("vec").alias("vec"))]).join(
        vecs.select("key", "fold", "label"), "key"))
    grid = heads.probe_grid({"plain": vecs, "unit": unit}, ["linear", "mlp", "lgbm", "knn"], 10)
    grid = grid.unionByName(heads.probe_grid({"joined": joined}, ["linear", "mlp"], 10))
    return grid.select("combo", "head", (F.col("mean").between(F.col("min"), 1.0) & F.col("std").between(0.0, 0.5)).alias("in_range"))


@query("ensemble", twins.ensemble())
def ensemble(spark, sf):
    sets = {"a": inputs.prob_table(spark, sf), "b": inputs.second_prob_table(spark, sf)}
    rows = vectors.ensemble(sets, {"a": 3.0, "b": 1.0})
    return rounded(rows.select("key", "label", "fold", *[F.get("probs", F.lit(i)).alias(f"p{i}") for i in range(3)]))


# --- tuning and decisions ------------------------------------------------------------------------

@query("tune_multipliers", twins.tune_multipliers())
def tune_multipliers(spark, sf):
    return rounded(tuning.tune_multipliers(inputs.prob_table(spark, sf)))


@query("nested_multipliers", twins.nested_multipliers())
def nested_multipliers(spark, sf):
    return rounded(tuning.nested_multipliers(inputs.prob_table(spark, sf))[0])


@query("nested_summary", twins.nested_summary())
def nested_summary(spark, sf):
    return rounded(tuning.nested_multipliers(inputs.prob_table(spark, sf))[1])


def _two_sets(spark, sf):
    second = inputs.second_prob_table(spark, sf).select("key", F.col("probs").alias("probs2"))
    return inputs.prob_table(spark, sf).join(second, "key")


@query("nested_weight_search", twins.nested_weight_search())
def nested_weight_search(spark, sf):
    return rounded(tuning.nested_weight_search(_two_sets(spark, sf), ["probs", "probs2"])[0])


@query("weight_search_summary", twins.weight_search_summary())
def weight_search_summary(spark, sf):
    return rounded(tuning.nested_weight_search(_two_sets(spark, sf), ["probs", "probs2"])[1])


def _decision(spark, sf):
    a, b = inputs.prob_table(spark, sf), inputs.second_prob_table(spark, sf)
    template = a.select(F.col("key").alias("pos"), F.col("key").alias("id"))
    tests = {"a": a.select("key", "probs"), "b": b.select("key", "probs")}
    return decide.decide({"a": a, "b": b}, tests, template, {"a": 3.0, "b": 1.0}, team="demo")


@query("ensemble_submission", twins.ensemble_submission())
def ensemble_submission(spark, sf):
    return _decision(spark, sf).submission


@query("submission_manifest", twins.submission_manifest())
def submission_manifest(spark, sf):
    """What the manifest records of the tables behind the submission, one column each."""
    m = _decision(spark, sf).manifest
    return rounded(m.select(
        "submission_number", "team_name", F.col("submission_digest.n_rows").alias("n_submitted"),
        F.col("submission_digest.content_sum").alias("submission_sum"), F.col("folds_digest.content_sum").alias("folds_sum"),
        F.concat_ws(",", "active_compositions").alias("compositions"),
        F.col("ensemble_weights")["a"].alias("weight_a"), F.col("ensemble_weights")["b"].alias("weight_b"),
        F.size("multipliers").alias("n_multipliers"), F.col("timestamp_utc").isNotNull().alias("is_dated")))


# --- experiment logs -------------------------------------------------------------------------------

@query("best_epoch", twins.best_epoch(8))
def best_epoch(spark, sf):
    return rounded(experiments.best_epoch(inputs.history_table(spark, sf), 8))


@query("best_epoch_no_patience", twins.best_epoch(None))
def best_epoch_no_patience(spark, sf):
    return rounded(experiments.best_epoch(inputs.history_table(spark, sf), None))


@query("verdict", twins.VERDICT)
def verdict(spark, sf):
    return experiments.verdict(inputs.history_table(spark, sf)).groupBy("run", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("pick_winner", twins.PICK_WINNER)
def pick_winner(spark, sf):
    return rounded(experiments.pick_winner(inputs.score_grid(spark, sf), ["task"], near=0.002, max_std=0.35))


@query("decide_variant", twins.DECIDE_VARIANT)
def decide_variant(spark, sf):
    grid = inputs.score_grid(spark, sf)
    both = [experiments.decide_variant(grid.where("head = 'N'"), grid.where(F.col("head") == h), ["task", "combo"])
            .withColumn("variant", F.lit(h)) for h in ("A", "R")]
    return rounded(both[0].unionByName(both[1]))


@query("upsert_results", twins.UPSERT_RESULTS)
def upsert_results(spark, sf):
    o = inputs.table(spark, sf, "orders")

    def best(status):
        return o.where(F.col("o_orderstatus").isin(status)).groupBy(F.col("o_custkey").alias("run_name")).agg(
            F.max("o_totalprice").alias("best"), F.count(F.lit(1)).alias("n"))

    return experiments.upsert_results(best(["F", "P"]), best(["O"]))


# --- pictures ---------------------------------------------------------------------------------------

def _as_picture(content: bytes):
    """The bytes of a page as a grey picture 32 pixels wide; an empty page is unreadable."""
    if not content:
        return None
    pixels = np.frombuffer(bytes(content), dtype=np.uint8)
    return np.pad(pixels, (0, -len(pixels) % 32)).reshape(-1, 32, 1)


def _pictures(spark, sf):
    return inputs.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"),
                                                   F.encode("html", "UTF-8").alias("content"))


@query("image_stats", twins.IMAGE_STATS)
def image_stats(spark, sf):
    return images.image_stats(images.image_health(_pictures(spark, sf), _as_picture))


@query("image_hash_groups", """SELECT count(*) AS n, count(DISTINCT CASE WHEN html <> '' THEN md5(html) END) AS contents,
  count(*) FILTER (WHERE html IS NULL OR html = '') AS unreadable, CAST(0 AS BIGINT) AS contents_with_two_hashes,
  CAST(0 AS BIGINT) AS hashes_in_two_groups FROM pages""")
def image_hash_groups(spark, sf):
    """Equal pictures have one hash, unreadable ones none, and equal hashes one group."""
    pictures = _pictures(spark, sf)
    hashes = images.phash64(pictures, _as_picture).select(F.col("path").alias("key"), F.col("phash").alias("hash"))
    groups = dedup.near_duplicates(hashes, 2, "components").select("key", "hash", "root")
    seen = freeze(groups.join(pictures.select(F.col("path").alias("key"), F.md5("content").alias("content")), "key"))
    per_content = seen.where(F.col("hash").isNotNull()).groupBy("content").agg(F.count_distinct("hash").alias("n"))
    per_hash = seen.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.count_distinct("root").alias("n"))
    row = seen.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hash").isNull()).alias("unreadable"))
    return beside(row, per_content.agg(F.count(F.lit(1)).alias("contents"), F.count_if(F.col("n") > 1).alias("contents_with_two_hashes")),
                  per_hash.agg(F.count_if(F.col("n") > 1).alias("hashes_in_two_groups")))


@query("batch_encode", twins.BATCH_ENCODE)
def batch_encode(spark, sf):
    def encoder():
        return lambda pictures: np.array([[p.shape[0], p.shape[1]] for p in pictures], dtype=np.float64)

    rows = images.encode(_pictures(spark, sf), encoder, [lambda p: p[:, ::-1]], _as_picture)
    return rows.select("path", F.get("vec", F.lit(0)).cast("double").alias("rows"), F.get("vec", F.lit(1)).cast("double")
                       .alias("columns"))


# --- files, templates, validators --------------------------------------------------------------------

@query("resolve_ordered_files", twins.RESOLVE_FILES)
def resolve_ordered_files(spark, sf):
    return tables.resolve_files(inputs.template_table(spark, sf), inputs.listing_table(spark, sf))


@query("template_alignment", twins.TEMPLATE_ALIGNMENT)
def template_alignment(spark, sf):
    template = inputs.template_table(spark, sf).select(F.col("pos").alias("id"))
    return vectors.template_alignment(inputs.vector_table(spark, sf).select(F.col("key").alias("id")), template)


@query("write_order", twins.WRITE_ORDER)
def write_order(spark, sf):
    pred = inputs.table(spark, sf, "labels").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.col("quality").alias("predicted"))
    return tables.submission(pred, inputs.template_table(spark, sf))


@query("validate_submission", twins.VALIDATE_SUBMISSION)
def validate_submission(spark, sf):
    return validate.validate_submission(write_order(spark, sf), inputs.template_table(spark, sf), 2)


@query("validate_shards", twins.VALIDATE_SHARDS)
def validate_shards(spark, sf):
    o = inputs.table(spark, sf, "orders")
    start, short = F.col("o_orderkey") * 10, F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    shards = o.select(start.alias("start"), (start + 10 - short).alias("end"), (10 - short).alias("n_rows"))
    return validate.validate_shards(shards, shards.count() * 10)


@query("shard_contiguity", twins.SHARD_CONTIGUITY)
def shard_contiguity(spark, sf):
    o = inputs.table(spark, sf, "orders")
    start, short = F.col("o_orderkey") * 10, F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    return validate.shard_contiguity(o.select(start.alias("start"), (start + 10 - short).alias("end")))


@query("validate_probs", twins.VALIDATE_PROBS)
def validate_probs(spark, sf):
    good = inputs.prob_table(spark, sf)
    fold = F.col("fold")
    spoiled = (F.when(fold == 0, F.array(F.lit(float("nan")), F.lit(0.5), F.lit(0.5)))
               .when(fold == 1, F.transform("probs", lambda x: x * 1.5)).when(fold == 2, F.slice("probs", 1, 2))
               .otherwise(F.col("probs")))
    bad = good.withColumn("probs", spoiled).withColumn(
        "label", F.when(fold == 3, 7).otherwise(F.col("label"))).where("label <> 1")
    return validate.validate_probs(bad, expected=good)


@query("validate_label_map", twins.VALIDATE_LABEL_MAP)
def validate_label_map(spark, sf):
    rows = inputs.table(spark, sf, "orders").select(
        P.class_id("o_orderstatus", ["F", "O", "P"]).alias("label"), F.col("o_orderstatus").alias("label_name"))
    return validate.validate_label_map(rows, ["F", "P", "O"])


@query("validate_weights", twins.VALIDATE_WEIGHTS)
def validate_weights(spark, sf):
    return validate.validate_weights(profile.class_weights(inputs.prob_table(spark, sf)), heaviest=2)


@query("expect_count", twins.EXPECT_COUNT)
def expect_count(spark, sf):
    n = inputs.table(spark, sf, "documents").count()
    return validate.expect_count(inputs.table(spark, sf, "labels"), n)


@query("compare_cv_oof", twins.compare_cv_oof())
def compare_cv_oof(spark, sf):
    return validate.compare_cv_oof(metrics.cv_summary(_scored(spark, sf)))


@query("handoff_report", twins.handoff_report())
def handoff_report(spark, sf):
    probs = inputs.prob_table(spark, sf)
    return validate.combine({
        "probs": validate.validate_probs(probs), "folds": validate.validate_folds(_folds(spark, sf)),
        "weights": validate.validate_weights(profile.class_weights(probs)),
        "vectors": validate.validate_vectors(inputs.vector_table(spark, sf)),
        "scores": validate.compare_cv_oof(metrics.cv_summary(metrics.with_pred(probs)))})


# --- files written and read back -----------------------------------------------------------

def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("folds_csv", twins.FOLDS_CSV)
def folds_csv(spark, sf):
    """The fold table as a CSV file in its contract, read back with types."""
    path = _new_folder(spark, "folds")
    tables.export_csv(_folds(spark, sf), path, schema.FOLDS_EXPORT)
    return tables.read_folds(spark, path)


@query("review_csv", twins.review_csv())
def review_csv(spark, sf):
    """The pending review log as a CSV file in its contract, read back with types and internal names."""
    path = _new_folder(spark, "review")
    tables.export_csv(review.init_review_log(review.review_order(_merged(spark, sf))), path, schema.REVIEW_EXPORT)
    return rounded(tables.read_review(spark, path))


@query("template_csv", twins.TEMPLATE_CSV)
def template_csv(spark, sf):
    """A submission template in file order: the lines of all files counted on from 0."""
    path = _new_folder(spark, "template")
    tables.export_csv(_folds(spark, sf), path, {"key": "id", "fold": "predicted"}, [F.desc("key")])
    return tables.read_template(spark, path)


@query("versioned_rows", twins.VERSIONED_ROWS)
def versioned_rows(spark, sf):
    """A table written twice: readers get the rows and the manifest of the second version."""
    path = _new_folder(spark, "versions")
    docs = inputs.document_table(spark, sf).select("key", "hash", "source", "n_chars")
    tables.write_versioned(inputs.table(spark, sf, "labels"), path)
    tables.write_versioned(docs, path, {"kind": "documents"}, allow_overwrite=True)
    rows, meta = tables.read_versioned(spark, path)
    return rows.select("*", F.lit(meta["n_rows"]).cast("bigint").alias("n_rows"), F.lit(meta["kind"]).alias("kind"),
                       F.lit(tables.is_complete(spark, path)).alias("complete"))


@query("summary_json", twins.DUPLICATE_SUMMARY)
def summary_json(spark, sf):
    """The duplicate summary as a JSON file, read back."""
    path = _new_folder(spark, "summary")
    row = dedup.duplicate_summary(inputs.document_table(spark, sf))
    tables.write_summary(row, path)
    return spark.read.schema(row.schema).json(path)
