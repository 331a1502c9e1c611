"""Licence scan by a positional index of rare licence words, in DataFrame functions only.

1. One pass cuts every whole text into words and keeps, per file, the word count and the distinct licence words present.
2. Document frequencies of the licence words over all files give their IDF.
3. A file is a candidate where all words of some template's key phrases (or of a base phrase) are present; nothing else
   could pass the verification. The rarest words of every template's key phrases are looked up by position in the template
   postings; equal relative positions vote for one alignment. An accepted alignment holds all of these words, so none is missed.
4. An alignment is accepted where every key phrase stands in the file at the place the alignment gives it.

Words are maximal runs of characters other than ASCII blanks, marks and controls, after lower-casing A-Z.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import store

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose places are counted exactly, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]  # key phrases, each a run of words of the text


# Public licence notices in lower-case words, and the phrases without which they say something else.
TEMPLATES = (
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3",
             ("gnu general public license version 3",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2",
             ("gnu general public license version 2",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
             "general public license as published by the free software foundation",
             ("gnu general public license", "free software foundation")),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu "
             "lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software "
             "foundation", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("cc-by", "licensed under a creative commons attribution license", ("creative commons attribution",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring "
             "rights to this work cc0", ("waived all copyright and related or neighboring rights",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files the software to deal in the software without restriction",
             ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
             "provided that the following conditions are met",
             ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
             "is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license v 2 0",)),
    Template("all-rights-reserved", "copyright all rights reserved", ("all rights reserved",)),
)


def words(text: Column) -> Column:
    """The words of a text; none for null. U+212A is the one character that lower() would turn into an ASCII letter."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Ω")))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _starts(of: str, phrase: str) -> str:
    """SQL: the phrase's words begin at i (from 0) in the array column."""
    return " AND ".join(f"get({of}, i + {k}) = '{w}'" if k else f"get({of}, i) = '{w}'"
                        for k, w in enumerate(phrase.split()))


def _candidate(present: str, templates: tuple[Template, ...]) -> Column:
    needs = {frozenset(" ".join(t.keys).split()) for t in templates} | {frozenset(p.split()) for p in BASE}
    needs = [n for n in needs if not any(o < n for o in needs)]
    tests = [F.forall(_strings(sorted(n)), lambda w: F.array_contains(present, w)) for n in sorted(needs, key=sorted)]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _key_starts(t: Template) -> list[int]:
    """Where each key phrase begins in the template."""
    text = t.text.split()
    return [next(i for i in range(len(text)) if text[i:i + len(k)] == k) for k in (key.split() for key in t.keys)]


def _postings(spark, templates: tuple[Template, ...], df: dict[str, int], rare: int, votes: int) -> DataFrame:
    """One row per place of a template's `rare` rarest key words, and the votes it needs: bounded by the templates."""
    rows = []
    for k, t in enumerate(templates):
        places = sorted({(s + i, w) for s, key in zip(_key_starts(t), t.keys) for i, w in enumerate(key.split())})
        rarest = sorted({w for _, w in places}, key=lambda w: (df.get(w, 0), w))[:rare]
        chosen = [(i, w) for i, w in places if w in rarest]
        rows += [(k, i, w, min(votes, len(chosen))) for i, w in chosen]
    return spark.createDataFrame(rows, "template int, at int, word string, need int")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, rare: int = 8, votes: int = 2) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found for every row.

    found: array of (label, first word, coverage), one per accepted alignment with the most coverage of its template.
    score: 1 where a base phrase stands, else the largest coverage (share of a template's words in place), else 0. Labels are
    distinct, sorted and comma-joined, empty where there is none. rare: how many of the rarest words of a
    template's key phrases are looked up (ties by word). A null text is empty. Repeated rows give repeated results.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for t in templates for w in t.text.split()} | {w for p in BASE for w in p.split()})
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("w", words(F.col("text")))
    rows = rows.withColumn("present", F.array_intersect("w", _strings(vocabulary)))
    # Texts are kept for candidates only.
    files = store(rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("bigint").alias("n_words"), "present",
        F.when(_candidate("present", templates), F.col("text")).alias("text")), "licenses")

    # At most one row per licence word.
    frequency = files.select(F.explode("present").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    df = {r["word"]: r["df"] for r in frequency.collect()}
    candidates = files.where(F.col("text").isNotNull()).select("row", words(F.col("text")).alias("w"))

    hits = candidates.select("row", F.posexplode("w").alias("pos", "word"))
    postings = F.broadcast(_postings(spark, templates, df, rare, votes))
    aligned = hits.join(postings, "word").groupBy("row", "template", (F.col("pos") - F.col("at")).alias("shift")).agg(
        F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    aligned = aligned.where(F.col("n") >= F.col("need")).select("row", F.struct("template", "shift").alias("a"))
    alignments = aligned.groupBy("row").agg(F.array_sort(F.collect_list("a")).alias("alignments"))

    texts = F.array(*[_strings(t.text.split()) for t in templates])
    labels = _strings([t.label for t in templates])
    spans = []
    for t in templates:
        spans.append(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(len(k.split())).alias("n"))
                               for s, k in zip(_key_starts(t), t.keys)]))
    verified = candidates.join(alignments, "row").withColumns({"_t": texts, "_l": labels, "_k": F.array(*spans)})
    accepted = F.expr("""
        filter(alignments, a -> forall(_k[a.template], k ->
            forall(sequence(k.s, k.s + k.n - 1), i -> get(w, a.shift + i) <=> _t[a.template][i])))""")
    covered = F.expr("""
        transform(ok, a -> struct(_l[a.template] AS label, cast(greatest(a.shift, 0) AS bigint) AS first,
            size(filter(sequence(0, size(_t[a.template]) - 1), i -> get(w, a.shift + i) <=> _t[a.template][i]))
                / size(_t[a.template]) AS coverage))""")
    found = verified.withColumn("ok", accepted).select("row", covered.alias("found"))

    places = candidates.select("row", F.expr(
        "filter(sequence(0, size(w) - 1), i -> " + " OR ".join(f"({_starts('w', p)})" for p in BASE) + ")").alias("at"),
        F.array_compact(F.array(*[F.when(F.expr(f"exists(sequence(0, size(w) - 1), i -> {_starts('w', p)})"), F.lit(label))
                                  for p, label in BASE.items()])).alias("base"))

    none = F.array().cast("array<string>")
    out = files.select("row", "doc_id", "n_words").join(places, "row", "left").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce(F.size("at"), F.lit(0)).cast("bigint").alias("n_base"),
        F.get("at", F.lit(0)).cast("bigint").alias("first_word"),
        F.when(F.size("at") > 0, F.element_at("at", -1)).cast("bigint").alias("last_word"),
        F.coalesce("base", none).alias("base"),
        F.coalesce("found", F.array().cast("array<struct<label:string,first:bigint,coverage:double>>")).alias("found"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.col("found.label"))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("found.coverage")), F.lit(0.0))).alias("score"),
        "found")


def twin_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL for scan() without `found`, over a table documents whose doc_id is unique.

    No index and no rarity: every template all of whose key phrases' words stand in their places at one shift.
    """
    def values(rows):
        return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)

    postings, keys = [], []
    for k, t in enumerate(templates):
        text = t.text.split()
        postings += [(k, i, w) for i, w in enumerate(text)]
        for phrase in t.keys:
            p = phrase.split()
            start = next(i for i in range(len(text)) if text[i:i + len(p)] == p)
            keys += [(k, start + i, w) for i, w in enumerate(p)]
    base = [(n, i, w, label) for n, (phrase, label) in enumerate(BASE.items()) for i, w in enumerate(phrase.split())]
    return f"""
WITH cut AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(replace(coalesce(text, ''), 'K', 'Ω')),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM cut),
postings(template, spot, word) AS (VALUES {values(postings)}), keys(template, spot, word) AS (VALUES {values(sorted(set(keys)))}),
base(phrase, spot, word, label) AS (VALUES {values(base)}),
labels(template, label) AS (VALUES {values([(k, t.label) for k, t in enumerate(templates)])}),
licence AS (SELECT * FROM words WHERE word IN (SELECT word FROM postings UNION SELECT word FROM base)),
n_keys AS (SELECT template, count(*) AS n FROM keys GROUP BY template), n_base AS (SELECT phrase, count(*) AS n FROM base GROUP BY phrase),
n_words AS (SELECT template, count(*) AS n FROM postings GROUP BY template),
accepted AS (SELECT l.doc_id, k.template, l.pos - k.spot AS shift FROM licence l JOIN keys k USING (word) JOIN n_keys USING (template)
  GROUP BY l.doc_id, k.template, l.pos - k.spot HAVING count(*) = max(n)),
covered AS (SELECT a.doc_id, a.template, a.shift, count(*) / max(n) AS coverage
  FROM accepted a JOIN postings p USING (template) JOIN n_words USING (template)
  JOIN licence l ON l.doc_id = a.doc_id AND l.pos = a.shift + p.spot AND l.word = p.word GROUP BY a.doc_id, a.template, a.shift),
placed AS (SELECT l.doc_id, b.phrase, b.label, l.pos - b.spot AS pos FROM licence l JOIN base b USING (word) JOIN n_base USING (phrase)
  GROUP BY l.doc_id, b.phrase, b.label, l.pos - b.spot HAVING count(*) = max(n)),
places AS (SELECT doc_id, count(DISTINCT pos) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM placed GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
  SELECT doc_id, label FROM placed UNION SELECT doc_id, label FROM accepted JOIN labels USING (template)) GROUP BY doc_id),
best AS (SELECT doc_id, max(coverage) AS coverage FROM covered GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1e0 ELSE coalesce(coverage, 0e0) END AS score
FROM cut LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)"""
