"""Substring dedup against every window of words."""

import numpy as np

from foldwright.llm import chunks

from llm_cases import LONG, needs_data


def windows(text, n=50):
    w = text.split()
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}


def flagged(texts):
    seen, out = set(), set()
    for doc, text in sorted(texts):
        own = windows(text)
        if own & seen:
            out.add(doc)
        seen |= own
    return out


def prose(rng, n):
    return [f"w{x}" for x in rng.zipf(1.3, n) % 5000]


def test_gear_equals_its_definition():
    data = np.frombuffer(np.random.default_rng(0).bytes(300), dtype=np.uint8)
    table, got = chunks.gear_table().tolist(), chunks.gear(data)
    for i in range(300):
        assert got[i] == sum(table[data[i - j]] << j for j in range(min(i + 1, chunks.WINDOW))) % (1 << 16)


def test_cuts_cover_the_words_and_survive_insertions():
    rng = np.random.default_rng(1)
    text = " ".join(prose(rng, 3000))
    shifted = "some words before it " + text
    a, b = chunks.cut([text.encode(), shifted.encode()])
    assert sum(n for _, _, n in a) == 3000 and all(1 <= n <= chunks.GAP for _, _, n in a)
    for start, stop, n in a:
        assert len(text.encode()[start:stop].split()) == n
    lead = len("some words before it ")
    common = {(s + lead, e + lead) for s, e, _ in a} & {(s, e) for s, e, _ in b}
    assert len(common) >= len(a) - 4


def test_cuts_equal_their_definition():
    rng = np.random.default_rng(3)
    texts = [" ".join(prose(rng, n)).encode() for n in (0, 1, 5, 13, 14, 60, 200)] + [b"a " * 40, b"  x\ty  z " * 30]
    for text, got in zip(texts, chunks.cut(texts)):
        led = b" " * chunks.WINDOW + text + b" "
        hashes = chunks.gear(np.frombuffer(led, dtype=np.uint8))
        ends = [i for i in range(1, len(led)) if led[i:i + 1].isspace() and not led[i - 1:i].isspace()]
        values = [int(hashes[i]) for i in ends]
        stops = {len(values) - 1} if values else set()
        for low in range(1 - chunks.GAP if values else 0, len(values)):
            run = range(max(low, 0), min(low + chunks.GAP, len(values)))
            stops.add(min(run, key=lambda k: (values[k], -k)))
        assert [stop for _, stop, _ in got] == [ends[k] - chunks.WINDOW for k in sorted(stops)]


def test_every_repeat_of_fifty_words_shares_a_stretch():
    """Whatever stands before and after the passage; 3,000 repeats of every length from 50 to 60."""
    rng = np.random.default_rng(4)
    for n in range(50, 61):
        texts = []
        for _ in range(3000):
            passage = prose(rng, n)
            texts += [" ".join(prose(rng, int(rng.integers(0, 40))) + passage + prose(rng, 20)).encode() for _ in range(2)]
        found = [{t[x[1]:x[2]] for x in chunks.stretches(c, chunks.SEED_WORDS)} for t, c in zip(texts, chunks.cut(texts))]
        assert all(a & b for a, b in zip(found[::2], found[1::2]))


def test_around():
    assert chunks.around(b" three four", b" three fours", True) == (6, 1, False)
    assert chunks.around(b"", b" more", True) == (0, 0, False)
    assert chunks.around(b" end ", b" end", True) == (4, 1, False)
    assert chunks.around(b" a b", b" a c", True) == (2, 1, False)
    assert chunks.around(b" a", b" a", False) == (2, 1, True)  # more may follow


def test_extension_beyond_the_reach(spark):
    """Chains that go on behind the compared bytes are compared over the whole texts."""
    rng = np.random.default_rng(5)
    shared = " ".join(prose(rng, 900))
    texts = {1: "first lead " + shared + " tail", 2: "quite another start " + shared + " end"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    a, b = (texts[k].index(shared) for k in (2, 1))
    middle = shared.index(" ", 2500) + 1
    stop = shared.index(" ", middle + 90)
    chain = [(2, None, a + middle, a + stop, 0, len(shared[middle:stop].split()), None, 1, b + middle)]
    rows = spark.createDataFrame(chain, chunks._CHAIN).drop("tag").join(chunks._texts(df).select("doc_id", "tag"), "doc_id")
    for reach in (40, 1024, 1 << 20):
        got = chunks.extend(rows, chunks._texts(df), reach).drop("tag").collect()
        assert [tuple(r) for r in got] == [(2, a, a + len(shared), 900, 1, b)]


def test_chains_with_another_first_holder_between(spark):
    """A passage that an earlier document holds as well parts a copy's chain; the copy is reported in one piece."""
    rng = np.random.default_rng(6)
    popular, lead, end = (" ".join(prose(rng, n)) for n in (30, 200, 200))
    rows = [(1, "start " + popular + " stop"), (2, f"{lead} {popular} {end}"), (3, f"x {lead} {popular} {end} y")]
    found = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).drop("tag").collect()
    assert [tuple(r) for r in found] == [(3, 2, 2 + len(rows[1][1]), 430, 2, 0)]


def test_loops(spark):
    """Loops of one to twelve words that begin and end at different places."""
    words = [f"turn{k}" for k in range(12)]
    rows = []
    for p in range(1, 13):
        lap = [f"{w}x{p}" for w in words[:p]]
        rows += [(2 * p, " ".join(["lead", *(lap * 90)[:90]])), (2 * p + 1, " ".join(["other", "lead", *(lap * 90)[p // 2:p // 2 + 70], "end"]))]
    found = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in found} == flagged(rows) == {2 * p + 1 for p in range(1, 13)}


def test_planted_passages(spark):
    rng = np.random.default_rng(2)
    texts = {k: prose(rng, int(rng.integers(60, 800))) for k in range(60)}
    for k in range(40, 60):
        passage = texts[k - 40][5:5 + 51 + k - 40]
        at = int(rng.integers(0, len(texts[k])))
        texts[k] = texts[k][:at] + passage + texts[k][at:]
    rows = [(k, " ".join(w)) for k, w in texts.items()]
    want = flagged(rows)
    found = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert {r["doc_id"] for r in found} == want and set(range(40, 60)) <= want
    by = dict(rows)
    for r in found:
        part = by[r["doc_id"]].encode()[r["start"]:r["stop"]]
        assert part == by[r["first_doc"]].encode()[r["first_start"]:r["first_start"] + len(part)]
        assert len(part.split()) == r["words"] >= 50
    # Every passage is reported at its full length.
    for k in range(40, 60):
        passage = " ".join(texts[k - 40][5:5 + 51 + k - 40])
        at = by[k].index(passage)
        assert any(r["doc_id"] == k and r["start"] <= at and r["stop"] >= at + len(passage) for r in found)


def test_edges(spark, edges, no_docs):
    """Copies of one id are one document; short texts, nulls and empty ones have no passage."""
    assert chunks.repeated_passages(edges).collect() == []
    assert chunks.repeated_passages(no_docs).collect() == []
    more = edges.select("doc_id", "text").union(spark.createDataFrame([(20, "before " + LONG), (21, LONG)], "doc_id bigint, text string"))
    found = chunks.repeated_passages(more)
    assert {(r["doc_id"], r["first_doc"]) for r in found.collect()} == {(20, 5), (21, 5)}
    left = {r["doc_id"]: r["text"] for r in chunks.remove_passages(more.where("doc_id >= 20"), found).collect()}
    assert left[21] == "" and left[20].split() == ["before"]


def test_removal_keeps_columns(edges):
    found = chunks.repeated_passages(edges)
    out = chunks.remove_passages(edges, found)
    assert out.columns == edges.columns and out.count() == edges.count()


@needs_data
def test_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert {r["doc_id"] for r in chunks.repeated_passages(documents).collect()} == flagged(rows)
