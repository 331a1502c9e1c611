"""Document fingerprints from closed syncmers, in DataFrame functions only.

Letters are words (runs of anything but white space). Each run of S words is hashed; a run of K words is chosen where the
least of its inner hashes stands first or last in it. Whether a run is chosen depends on its own words alone, so equal
passages give equal anchors wherever they stand. The fingerprint lists the SKETCH smallest 32-bit anchor hashes, and the
likeness of two fingerprints estimates the Jaccard similarity of the anchor sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.operators.ordering import ordered_chunks

S, K, SKETCH = 2, 5, 64  # K - S + 1 = 4 inner hashes
_BITS = 32
_NO_ID = -(1 << 63)  # sorts first


def _with_anchors(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep and _n (words), _h (hash of each S words), _at (places of the chosen runs)."""
    df = df.select(*keep, F.array_remove(F.split(F.col(text), r"\s+"), "").alias("_w"))
    df = df.select(*keep, F.size("_w").alias("_n"), F.zip_with(
        F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", 2, F.size("_w") + 1),
        lambda a, b: F.xxhash64(a, b)).alias("_h"), F.array_join(F.slice("_w", 1, K - 1), " ").alias("_head"))
    two = F.zip_with("_h", F.slice("_h", 2, F.size("_h") + 1), lambda a, b: F.least(a, b))
    df = df.select(*keep, "_n", "_h", "_head", two.alias("_m"))
    four = F.zip_with("_m", F.slice("_m", 3, F.size("_m") + 1), lambda a, b: F.least(a, b))
    df = df.select(*keep, "_n", "_h", "_head", four.alias("_m"))
    at = F.expr(f"""CASE WHEN _n >= {K} THEN filter(sequence(0, _n - {K}),
        i -> get(_h, i) = get(_m, i) OR get(_h, i + {K - S}) = get(_m, i)) ELSE cast(array() AS array<int>) END""")
    return df.select(*keep, "_n", "_h", "_head", at.alias("_at"))


def _hashes() -> Column:
    inner = ", ".join(f"get(_h, i + {j})" for j in range(K - S + 1))
    # Fewer than K words: they are the one anchor.
    return F.expr(f"""CASE WHEN _n >= {K} THEN transform(_at, i -> shiftrightunsigned(xxhash64({inner}), {64 - _BITS}))
        WHEN _n > 0 THEN array(shiftrightunsigned(xxhash64(_head), {64 - _BITS})) ELSE cast(array() AS array<bigint>) END""")


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sketch of a text column: its at most SKETCH smallest distinct anchor hashes, ascending."""
    keep = df.columns
    df = _with_anchors(df, text, keep).select(*keep, _hashes().alias("_a"))
    return df.select(*keep, F.slice(F.sort_array(F.array_distinct("_a")), 1, SKETCH).alias(name))


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, anchors for every row: array of (hash, first word), in text order. A null text has none."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = _with_anchors(rows, "_text", ["doc_id"]).withColumn("_a", _hashes())
    pairs = F.arrays_zip(F.col("_a").alias("hash"), F.when(F.col("_n") >= K, F.col("_at")).otherwise(
        F.when(F.col("_n") > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))).alias("first"))
    return rows.select("doc_id", F.col("_n").cast("bigint").alias("n_words"), pairs.alias("anchors"))


def fingerprint(sketch: str) -> Column:
    """A sketch as text: eight hexadecimal digits per hash, empty without words."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), _BITS // 4, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the anchor sets behind two sketches; 1 for two empty ones."""
    joint = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    both = F.array_intersect(F.array_intersect(F.col(a), F.col(b)), joint)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        F.coalesce(F.size(both) / F.nullif(F.size(joint), F.lit(0)), F.lit(0.0)))


def _successors(ids: DataFrame) -> DataFrame:
    """(_doc, _key) of each row's next row in that order, the first after the last, as next_id and next_key."""
    rows = ordered_chunks(ids, [F.asc("_doc"), F.asc("_key")])
    inside = Window.partitionBy("_chunk").orderBy("_pos")
    rows = rows.withColumn("_next", F.lead(F.struct("_doc", "_key")).over(inside))
    # One row per chunk, so this window is as long as there are chunks.
    firsts = rows.groupBy("_chunk").agg(F.min_by(F.struct("_doc", "_key"), "_pos").alias("_first"))
    chunks = Window.orderBy("_chunk")
    whole = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("_chunk", F.coalesce(F.lead("_first").over(chunks), F.first("_first").over(whole)).alias("_wrap"))
    rows = rows.join(F.broadcast(firsts), "_chunk").withColumn("_next", F.coalesce("_next", "_wrap"))
    return rows.select("_doc", "_key", "_n", F.col("_next._doc").alias("next_id"), F.col("_next._key").alias("next_key"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch for every document.

    The edited text is the text with its last floor(n/2) code points replaced by the first as many of the next document
    in ascending doc_id (the first one after the last; a lone document is its own next). Rows equal in doc_id and text are
    one document and give one row; other rows with one doc_id follow each other by a hash of the text. A null doc_id comes
    first, a null text is empty.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("text", F.coalesce("doc_id", F.lit(_NO_ID)).alias("_doc"),
                       F.xxhash64("text", F.col("doc_id").isNull()).alias("_key"))
    ids = rows.groupBy("_doc", "_key").agg(F.max(F.length("text")).alias("_n"), F.count(F.lit(1)).alias("_rows"))
    follow = _successors(ids.select("_doc", "_key", "_n"))
    # For each document: who precedes it, and how much of its text that one takes.
    wanted = follow.select(F.col("next_id").alias("_doc"), F.col("next_key").alias("_key"), F.col("_doc").alias("_to_id"),
                           F.col("_key").alias("_to_key"), F.floor(F.col("_n") / 2).cast("int").alias("_half"))
    texts = with_sketch(rows, "text", "sketch")
    if not ids.where(F.col("_rows") > 1).isEmpty():
        texts = texts.dropDuplicates(["_doc", "_key"])
    given = texts.join(wanted, ["_doc", "_key"]).select(
        F.col("_to_id").alias("_doc"), F.col("_to_key").alias("_key"),
        F.substring("text", F.lit(1), F.col("_half")).alias("_tail"), F.col("sketch").alias("next_sketch"))
    # Both joins read the texts with the same columns and key, so Spark shuffles them once.
    out = texts.join(given, ["_doc", "_key"]).withColumn("n_chars", F.length("text").cast("bigint"))
    out = out.withColumn("doc_id", F.nullif("_doc", F.lit(_NO_ID)))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int"))
    out = out.select("doc_id", "n_chars", "sketch", "next_sketch", F.concat(kept, "_tail").alias("edited"))
    out = with_sketch(out, "edited", "edited_sketch")
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "edited_sketch",
                      "next_sketch")
