"""Closed syncmers against a plain version in Python, with the same 64-bit hash."""

import hashlib
import re
import struct

import xxhash

from foldwright.llm import syncmers

from llm_cases import EDGES, needs_data


def xx(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def anchors(text):
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text) if x]
    if len(w) < 5:
        return [(xx(" ".join(w)), 0)] if w else []
    h = [xx(w[i], w[i + 1]) for i in range(len(w) - 1)]
    return [(xx(*h[i:i + 4]), i) for i in range(len(w) - 4) if min(h[i:i + 4]) in (h[i], h[i + 3])]


def sketch(text):
    return sorted({(a & (2 ** 64 - 1)) >> 32 for a, _ in anchors(text)})[:syncmers.SKETCH]


def likeness(a, b):
    joint = sorted(set(a) | set(b))[:syncmers.SKETCH]
    return len(set(joint) & set(a) & set(b)) / len(joint) if joint else 1.0


def compared(docs):
    out = syncmers.compare_edited(docs)
    return out.select("doc_id", "n_chars", "edited_sha256", syncmers.fingerprint("sketch").alias("f"),
                      syncmers.fingerprint("edited_sketch").alias("e"), syncmers.likeness("sketch", "edited_sketch").alias("near_edited"),
                      syncmers.likeness("sketch", "next_sketch").alias("near_next")).collect()


def expected(texts):
    out = []
    for k, (doc, text) in enumerate(texts):
        after, n = texts[(k + 1) % len(texts)][1], len(text)
        edited = text[:n - n // 2] + after[:n // 2]
        a, e = sketch(text), sketch(edited)
        show = lambda s: "".join(f"{x:08X}" for x in s)
        out.append((doc, n, hashlib.sha256(edited.encode()).hexdigest(), show(a), show(e), round(likeness(a, e), 9),
                    round(likeness(a, sketch(after)), 9)))
    return sorted(out, key=repr)


def rounded(rows):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, rows)), key=repr)


@needs_data
def test_documents(documents):
    texts = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    assert rounded(compared(documents)) == expected(texts)


def test_edges(edges):
    """Rows equal in id and text are one; null ids come first; rows with one id follow by a hash of the text."""
    keys = {(d, t or "") for d, t in EDGES}
    order = sorted(keys, key=lambda r: ((r[0] is not None), r[0] or 0, xxhash_key(r)))
    assert rounded(compared(edges)) == expected(order)


def xxhash_key(row):
    doc, text = row
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<i", int(doc is None)), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_anchors(edges):
    got = sorted(((r["doc_id"], r["n_words"], [(a["hash"], a["first"]) for a in r["anchors"]])
                  for r in syncmers.anchors(edges).collect()), key=repr)
    want = []
    for doc, text in EDGES:
        words = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text or "") if x]
        want.append((doc, len(words), [((a & (2 ** 64 - 1)) >> 32, i) for a, i in anchors(text or "")]))
    assert got == sorted(want, key=repr)


def test_equal_passages_share_anchors():
    passage = " ".join(f"word{i}" for i in range(40))
    a, b = (dict(anchors(f"{lead} {passage} {end}")) for lead, end in (("x y z", "q"), ("other words before it all", "r s")))
    own = dict(anchors(passage))
    assert set(own) <= set(a) and set(own) <= set(b)
    assert len({a[h] - b[h] for h in own}) == 1


def test_alone_and_empty(spark, no_docs):
    alone = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    row = compared(alone)[0]
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"a b c a b c"[:6] + b"a b c").hexdigest()
    assert compared(no_docs) == []
