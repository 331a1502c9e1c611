"""Licence scan against a plain scan in Python."""

import re

from foldwright.llm import licenses

from llm_cases import EDGES, needs_data

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    w = WORD.findall((text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def check(out, texts):
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out), key=repr)
    assert got == sorted(((k, *base(t)) for k, t in texts), key=repr)
    for r in out:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert r["labels"].split(",") == sorted(set(r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_edges(spark, edges):
    check(licenses.scan(edges).collect(), EDGES)


def test_templates_are_found_in_place(spark):
    rows = [(k, f"alpha beta {t.text} gamma") for k, t in enumerate(licenses.TEMPLATES)]
    rows += [(100, "GNU General Public License, version 3"), (101, "the mit license; MIT LICENSE"), (102, "mit licenſe"),
             (103, "under cc-by 4.0"), (104, "KLicense Apache License"), (105, None), (106, "licensed under cc by nc 4 0 " * 3)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    check(out, rows)
    by = {r["doc_id"]: r for r in out}
    for k, t in enumerate(licenses.TEMPLATES):
        assert t.label in by[k]["labels"].split(","), t
        assert any(f["label"] == t.label and f["first"] == 2 and f["coverage"] == 1.0 for f in by[k]["found"])
    assert by[106]["n_base"] == 3 and "cc-by-nc" in by[106]["labels"]
    assert by[105]["labels"] == "" and by[105]["n_words"] == 0


def test_several_notices_in_one_file(spark):
    """Every notice of a file is found, whatever else uses licence words, in a short and in a very long text."""
    by = {t.label: t.text for t in licenses.TEMPLATES}
    words_ = sorted({w for t in licenses.TEMPLATES for w in t.text.split()})
    scattered = " ".join(f"{words_[i % len(words_)]} w{i}" for i in range(10_000))
    rows = [(1, " and ".join(by[k] for k in ("bsd", "isc", "gpl-3.0", "mpl-2.0"))), (2, " ; ".join(t.text for t in licenses.TEMPLATES)),
            (3, f"{scattered} {by['apache-2.0']} {scattered}"), (4, by["mit"] + " " + by["apache-2.0"])]
    rows += [(k, "licensed under the apache license version 2 0") for k in range(10, 40)]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    labels = {k: {f["label"] for f in r["found"]} for k, r in out.items()}
    assert labels[1] == {"bsd", "isc", "gpl-3.0", "mpl-2.0"} and labels[2] >= {t.label for t in licenses.TEMPLATES}
    assert labels[3] == {"apache-2.0"} and labels[4] == {"mit", "apache-2.0"}


def test_missing_key_phrase_is_no_licence(spark):
    text = "permission is hereby granted free of charge to any person obtaining a copy of this book"
    out = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert out["labels"] == "" and out["score"] == 0


def test_empty_table(no_docs):
    assert licenses.scan(no_docs).collect() == []


@needs_data
def test_documents(documents):
    check(licenses.scan(documents).collect(), [(r["doc_id"], r["text"]) for r in documents.collect()])
