"""The corpus pipeline: its stages in order, each applied to all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run() writes
each stage's result in the cluster's shared folder and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm import decontaminate, language, neardup, packing, pii
from foldwright.llm.common import store, table
from foldwright.llm.queries import PII_KEY, TOKENIZER

#: A text is in none of the learned languages (another script) if the best one needs more bits per character of it.
MOST_BITS = 8.0
#: Shorter texts say too little about that.
LEAST_CHARS = 64


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: keep documents with letters that are written in a learned language; lang becomes the prediction.

    Without any learned language, all documents with letters stay as they are.
    """
    model = language.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = docs.columns
    judged = language.identify(docs, model, keep=names)
    foreign = (F.col("bits") > MOST_BITS) & (F.length("text") >= LEAST_CHARS)
    kept = judged.where((F.col("lang_pred") != language.UNDETERMINED) & ~foreign)
    return kept.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(c) for c in names])


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group the document with the least doc_id stays, once."""
    return neardup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold an item go."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    found = store(found.select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti")


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: personal numbers, dates and addresses become pseudonyms of their format; n_chars follows the text."""
    out = pii.pseudonymize(docs, PII_KEY)
    names = docs.columns
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in names])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the pieces of every document and their places."""
    return packing.place(packing.tokenize(docs, TOKENIZER).drop("ids"))


STAGES = [
    ("language ID", identify),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("PII", pseudonymize),
    ("best-fit packing", pack),
]

#: Fitted models, sampling and tokenisation cannot be said in SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
