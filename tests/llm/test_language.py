"""Language ID: held-out accuracy, phrases against a plain parse, edge rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.llm import language

from llm_cases import EDGES, needs_data


def phrases(sample, text):
    """Greedy cross-parsing, written plainly: blocks of language.BLOCK characters, each started afresh."""
    n = 0
    for at in range(0, len(text), language.BLOCK):
        block, begin, k = text[at:at + language.BLOCK], 0, 0
        n += 1
        while k < len(block):
            if block[begin:k + 1] in sample:
                k += 1
            else:
                n += 1
                begin, k = (k, k + 1) if block[k] in sample else (k + 1, k + 1)
    return n


def test_automaton_holds_every_substring():
    text = "abcabxabcd bcab"
    state, code, to = language.suffix_automaton(text)
    step = {(s, c): t for s, c, t in zip(state.tolist(), code.tolist(), to.tolist())}

    def inside(word):
        s = 0
        for ch in word:
            s = step.get((s, ord(ch)))
            if s is None:
                return False
        return True

    for a in range(len(text)):
        for b in range(a, len(text)):
            assert inside(text[a:b + 1])
    assert not inside("abd") and not inside("dd")


def test_phrases_equal_plain_parse():
    rng = np.random.default_rng(1)
    samples = ["".join(rng.choice(list("abcde "), 300)), "".join(rng.choice(list("defgh "), 300))]
    samples = [" ".join(s.split()) for s in samples]
    model = language.Model(["x", "y"], [len(s) for s in samples], [language.suffix_automaton(s) for s in samples])
    texts = ["".join(rng.choice(list("abcdefghz. !"), n)) for n in (0, 1, 5, 40, 256, 257, 900)] + ["zzz", "", "..."]
    got, n = language._Parser(model).phrases(texts)
    for t, g, size in zip(texts, got, n):
        collapsed, blank = "", True
        for c in t.lower():  # as the parser does: one separator for a run, none at the beginning
            if c.isalpha():
                collapsed, blank = collapsed + c, False
            elif not blank:
                collapsed, blank = collapsed + " ", True
        assert size == len(collapsed)
        assert [phrases(s, collapsed) for s in samples] == g.tolist()


@needs_data
def test_held_out_accuracy(documents):
    rows = language.identify(documents, language.fit(documents)).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    own = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert len(own) > 20 and np.mean(own) > 0.97


@needs_data
def test_held_out_rows_teach_nothing(documents):
    changed = documents.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert language.fit(changed).key() == language.fit(documents).key()


def test_edges(spark, edges):
    taught = spark.createDataFrame([(k, t, l) for k in range(100, 140) for t, l in (
        ("the house and the garden of the king", "en"), ("das haus und der garten des koenigs", "de"))],
        "doc_id bigint, text string, lang string")
    out = language.identify(edges, language.fit(taught)).collect()
    assert len(out) == len(EDGES)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    for doc in (3, 4, 6, 7):
        assert by[doc][0]["lang_pred"] == "und" and by[doc][0]["score"] == 0
    assert {r["lang_pred"] for r in by[1]} == {"en"} and len(by[1]) == 2
    assert all(r["held_out"] is False for r in by[None])


def test_nothing_learned(edges, no_docs):
    model = language.fit(no_docs)
    assert model.languages == []
    assert {r["lang_pred"] for r in language.identify(edges, model).collect()} == {"und"}
    assert language.identify(no_docs, model).collect() == []


def test_every_label_is_learned_however_many(spark):
    """90 languages, above the number that gets full samples: each is predicted, the rare one too; too many are an error."""
    rng = np.random.default_rng(12)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    vocabulary = {f"l{k:02d}": ["".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(40)] for k in range(90)}
    rows = []
    for i in range(90 * 24):
        name = f"l{i % 90:02d}"
        if name == "l89" and i > 90 * 8:
            name = "l00"
        rows.append((i, " ".join(rng.choice(vocabulary[name], 40)), name))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(df)
    assert model.languages == sorted(vocabulary) and sum(model.lengths) <= 64 * 49_152
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, model).collect()}
    truth = {i: name for i, _, name in rows}
    assert np.mean([got[i] == truth[i] for i in truth]) > 0.98
    assert all(got[i] == "l89" for i in truth if truth[i] == "l89")
    with pytest.raises(ValueError):
        language.fit(df, full_samples=8, sample_rows=32)
