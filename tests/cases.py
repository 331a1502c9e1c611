"""Builders shared by the test modules. Helpers live here and never in a conftest, whose module name every folder shares."""


def prob_rows(spark, rows):
    """[(key, label, fold, probs)] -> table"""
    return spark.createDataFrame(rows, "key bigint, label int, fold int, probs array<double>")
