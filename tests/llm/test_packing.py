"""Packing against the tokenizer itself; the plan against its lower bound."""

import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foldwright.llm import packing
from foldwright.llm.queries import TOKENIZER

from llm_cases import EDGES, needs_data


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


def check(rows, texts, tokenizer, size):
    """texts: [(doc_id, text)]. Every document's ids are there once, in order; sequences have no gap."""
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    want = []
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        start, piece = 0, 0
        while start < len(ids):
            length = (len(ids) % size or size) if piece == 0 else size
            part = array("I", ids[start:start + length])
            want.append((doc, piece, start, length, zlib.crc32(part.tobytes())))
            start, piece = start + length, piece + 1
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_edges(edges, tokenizer):
    rows = packing.pack(edges, TOKENIZER).collect()
    check(rows, EDGES, tokenizer, packing.SIZE)
    for r in rows:
        assert zlib.crc32(array("I", r["ids"]).tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]


def test_other_size(edges, tokenizer):
    check(packing.pack(edges, TOKENIZER, size=64).collect(), EDGES, tokenizer, 64)


def test_empty_table(no_docs):
    assert packing.pack(no_docs, TOKENIZER).collect() == []


@needs_data
def test_documents(documents, tokenizer):
    rows = packing.pack(documents, TOKENIZER).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in documents.collect()], tokenizer, packing.SIZE)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.03 * total / packing.SIZE + 1


def test_engines_agree(tokenizer):
    encoder = packing._Encoder(TOKENIZER)
    assert encoder.engine is not None
    for text in ["", " ", "a  b", "a\n\n b\t c", "x" * 5000, "it's we'll <|endoftext|> don't", "漢字   ​ é", "12345 6.7"]:
        assert list(array("I", encoder(text))) == tokenizer.encode(text, add_special_tokens=False).ids


def test_patterns_fill_a_sequence():
    p = packing.patterns(12)
    assert (p.sum(1) == 12).all() and len({tuple(x) for x in p.tolist()}) == len(p)
    want = {(a, b, 12 - a - b) for a in range(1, 13) for b in range(1, a + 1) if 0 <= 12 - a - b <= b}
    assert {tuple(x) for x in p.tolist()} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=33, max_size=33))
def test_plan_uses_every_piece_once(counts):
    counts = np.array([0, *counts[1:]])
    used = np.zeros_like(counts)
    n = 0
    for lengths, repeats in packing.plan(counts):
        assert sum(lengths) <= 32 and repeats > 0
        n += repeats
        for v in lengths:
            used[v] += repeats
    assert (used == counts).all()
    bound = max(-(-int((counts * np.arange(33)).sum()) // 32), int(counts[17:].sum()))
    assert n <= 1.12 * bound + 3
