"""The registered queries of the operators, one per operator, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from foldwright.llm import (
    centroids, chunks, decontaminate, language, licenses, neardup, packing, pii, secrets, syncmers, turns, urls, warc,
)
from foldwright.llm.common import scratch, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), TOKENIZER)
    return packing.place(pieces.drop("ids")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op2_language_id")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


@query("op4_license_scan", licenses.twin_sql())
def op4(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("found")


@query("op5_document_fingerprints")
def op5(spark, sf_dir):
    return syncmers.compare_edited(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", "edited_sha256", syncmers.fingerprint("sketch").alias("fingerprint"),
        syncmers.fingerprint("edited_sketch").alias("edited_fingerprint"),
        syncmers.likeness("sketch", "edited_sketch").alias("near_edited"),
        syncmers.likeness("sketch", "next_sketch").alias("near_next"))


@query("op10_warc_round_trip", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f""")
def op10(spark, sf_dir):
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_archives(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: For the test data only; a user passes a secret.
PII_KEY = "test-data-key"


@query("op9_pii_pseudonyms")
def op9(spark, sf_dir):
    out = pii.pseudonymize(table(spark, sf_dir, "documents"), PII_KEY)
    return out.select("doc_id", "text", F.size("pseudonyms").cast("bigint").alias("n_replaced"), pii.kinds().alias("kinds"))


@query("op3_substring_dedup")
def op3(spark, sf_dir):
    return chunks.repeated_passages(table(spark, sf_dir, "documents")).drop("tag")


_URL_SQL = r"""
WITH parsed AS (
  SELECT page_id, url, CAST(DATE '2021-01-01' + CAST(page_id * 104729 % 1461 AS INTEGER) AS DATE) AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'),
                     lambda s: s <> '') AS segments
  FROM pages),
p AS (SELECT *, string_split(host, '.') AS labels FROM parsed),
events AS (
  SELECT CASE page_id % 3 WHEN 0 THEN 'malware' WHEN 1 THEN 'adult' ELSE 'ads' END AS list,
         CASE WHEN page_id % 11 = 0 AND len(segments) > 0 THEN host || '/' || segments[1]
              WHEN page_id % 4 = 0 THEN array_to_string(labels[-2:], '.') ELSE host END AS entry,
         page_id % 5 < 2 AS is_on, CAST(DATE '2021-01-01' + CAST(page_id * 7919 % 1461 AS INTEGER) AS DATE) AS day
  FROM p),
days AS (SELECT list, entry, day, bool_or(is_on) AS is_on FROM events GROUP BY ALL),
changes AS (SELECT * FROM (SELECT *, coalesce(lag(is_on) OVER (PARTITION BY list, entry ORDER BY day), false) AS was FROM days)
            WHERE is_on <> was),
valid AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, entry ORDER BY day) AS valid_to FROM changes) WHERE is_on),
asked AS (
  SELECT page_id, fetched, unnest(list_distinct(list_concat(
    CASE WHEN len(labels) < 3 THEN [host] ELSE list_transform(range(1, len(labels)), lambda i: array_to_string(labels[i:], '.')) END,
    list_transform(range(1, len(segments) + 1), lambda i: host || '/' || array_to_string(segments[1:i], '/'))))) AS entry
  FROM p),
hits AS (SELECT DISTINCT a.page_id, v.list FROM asked a JOIN valid v ON a.entry = v.entry AND a.fetched >= v.day
         AND (v.valid_to IS NULL OR a.fetched < v.valid_to)),
lists AS (SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists FROM hits GROUP BY page_id)
SELECT p.page_id, p.fetched, l.lists IS NOT NULL AS blocked, coalesce(l.lists, '') AS lists
FROM p LEFT JOIN lists l USING (page_id)"""


@query("op6_url_filter", _URL_SQL)
def op6(spark, sf_dir):
    """Every page is a capture on a date made from its id, and one dated event for its host, domain or path."""
    def day(factor):
        return F.date_add(F.lit("2021-01-01").cast("date"), (F.col("page_id") * factor % 1461).cast("int"))

    pages = table(spark, sf_dir, "pages").select("page_id", "url", day(104729).alias("fetched"))
    host = urls.host(F.col("url"))
    domain = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    segment = F.filter(F.split(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"),
                       lambda s: s != "")
    events = pages.select(
        F.element_at(F.array(F.lit("malware"), F.lit("adult"), F.lit("ads")), (F.col("page_id") % 3 + 1).cast("int")).alias("list"),
        F.when((F.col("page_id") % 11 == 0) & (F.size(segment) > 0), F.concat_ws("/", host, F.get(segment, F.lit(0))))
        .when(F.col("page_id") % 4 == 0, F.when(F.size(F.split(host, r"\.")) < 2, host).otherwise(domain))
        .otherwise(host).alias("entry"),
        F.when(F.col("page_id") % 5 < 2, "add").otherwise("remove").alias("action"), day(7919).alias("day"))
    return urls.filter_captures(pages, events).select("page_id", "fetched", "blocked", "lists")


@query("op7_minhash_near_dedup")
def op7(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of")


@query("op8_benchmark_decontamination")
def op8(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_conversation_repair")
def op11(spark, sf_dir):
    return turns.damaged_and_repaired(table(spark, sf_dir, "conversations"))


@query("op12_centroid_clustering", centroids.twin_sql())
def op12(spark, sf_dir):
    return centroids.with_inertia(*centroids.cluster(table(spark, sf_dir, "embeddings")))


@query("op13_secret_scan")
def op13(spark, sf_dir):
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))
