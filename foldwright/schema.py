"""Table contracts shared by every module.

Rows are matched by key, never by position. Class ids run from 0 to K-1.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The default label map.
CLASS_NAMES = ("Recyclable", "Electronic", "Organic")
FOLDER_LABELS = {"0_Recyclable": 0, "1_Electronic": 1, "2_Organic": 2}
PRIORITY_PAIRS = ((0, 2), (2, 0))
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")
DECISIONS = ("keep", "relabel", "drop")

# Names inside the engine -> headers of the exchanged files, in their order.
ISSUE_EXPORT = {
    "key": "filepath", "fold": "fold", "label": "label_asli", "label_name": "label_asli_name",
    "pred_class": "label_predicted", "pred_name": "label_predicted_name",
    "quality": "label_quality_score", "confidence": "confidence", "margin": "margin",
    "entropy": "entropy", "is_high_priority": "is_high_priority",
}
AMBIGUOUS_EXPORT = {
    "key": "filepath", "fold": "fold", "label": "label", "pred_class": "pred_class",
    "margin": "margin", "entropy": "entropy", "top1": "top1_prob", "top2": "top2_prob",
    "pair": "pair_label_pred", "is_priority_pair": "is_priority_pair", "source": "ambig_source",
    "is_double_flagged": "is_double_flagged",
}
REVIEW_EXPORT = {
    "key": "filepath", "fold": "fold", "label_old": "label_asli", "label_new": "label_baru",
    "decision": "keputusan", "reason": "alasan", "reviewer": "reviewer", "margin": "margin",
    "quality": "label_quality_score", "is_double_flagged": "is_double_flagged",
}
FOLDS_EXPORT = {"key": "filepath", "label": "label", "fold": "fold"}

FOLDS = T.StructType([
    T.StructField("filepath", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("fold", T.IntegerType()),
])
TEMPLATE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("predicted", T.IntegerType()),
])
REVIEW = T.StructType([
    T.StructField("filepath", T.StringType()),
    T.StructField("fold", T.IntegerType()),
    T.StructField("label_asli", T.IntegerType()),
    T.StructField("label_baru", T.IntegerType()),
    T.StructField("keputusan", T.StringType()),
    T.StructField("alasan", T.StringType()),
    T.StructField("reviewer", T.StringType()),
    T.StructField("margin", T.DoubleType()),
    T.StructField("label_quality_score", T.DoubleType()),
    T.StructField("is_double_flagged", T.BooleanType()),
])
