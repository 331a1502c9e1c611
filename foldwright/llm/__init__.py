"""Operators for training-data pipelines: language, duplicates, licences, fingerprints, URLs, PII, WARC, packing,
conversations, clusters, secrets.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames and selects the columns
it needs, so further columns of its input never clash with its own.
"""
