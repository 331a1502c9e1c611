"""Decontamination: subsequences by definition, the factorisation, recall against brute force, edge rows."""

import numpy as np

from foldwright.llm import decontaminate
from foldwright.llm.shingles import words

from llm_cases import SF, needs_data


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_lcs_by_definition():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(1, 70)).tolist() for _ in range(2))
        assert decontaminate.lcs_length(a, b) == lcs(a, b)


def space_of(spark, items, rank=decontaminate.RANK):
    """The latent space of item texts, with even weights."""
    idf = np.ones(1 << decontaminate.CELL_BITS, dtype=np.float32)
    df = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").repartition(3)
    cut = df.mapInArrow(decontaminate._cut, "item_id bigint, text string, nth bigint, words binary").where("nth >= 0")
    held = [words([t])[0] for t in items]
    vocabulary = np.unique(np.concatenate(held))
    send = spark.sparkContext.broadcast
    v = decontaminate.factorise(cut, cut.count(), send(vocabulary), send(idf), rank)
    return decontaminate._Space(list(range(len(items))), held, v, vocabulary, idf), idf


def plain_rows(space, idf):
    """The passages as a dense matrix."""
    a = np.zeros((len(space.place), len(space.vocabulary)))
    _, weight = decontaminate._padded([space.vocabulary[p[p >= 0]].tobytes() for p in space.place], space.vocabulary, idf)
    for row, p, w in zip(a, space.place, weight):
        np.add.at(row, p[p >= 0], w[p >= 0])
    return a


def prose(rng, topics, n):
    """Words of a topic each, so that there is something to factorise."""
    mine = topics[rng.integers(0, len(topics))]
    return [f"w{x}" for x in rng.choice(mine, n)]


def test_factorisation_spans_the_leading_directions(spark):
    rng = np.random.default_rng(1)
    topics = [rng.choice(3000, 60, replace=False) for _ in range(12)]
    space, idf = space_of(spark, [" ".join(prose(rng, topics, 150)) for _ in range(40)], 12)
    a = plain_rows(space, idf)
    v = space.v[:-1].astype(float)
    assert v.shape[1] == 12 < len(a) and np.allclose(v.T @ v, np.eye(12), atol=1e-3)
    s = np.linalg.svd(a, compute_uv=False)
    assert ((a @ v) ** 2).sum() >= 0.98 * (s[:12] ** 2).sum()


def test_latent_cosine_is_not_the_plain_one(spark):
    """Fewer directions than passages: passages of one topic without a common word are near in the space, and only there."""
    rng = np.random.default_rng(2)
    topics = [rng.choice(3000, 120, replace=False) for _ in range(8)]
    of = [rng.integers(0, 8) for _ in range(60)]
    space, idf = space_of(spark, [" ".join(f"w{x}" for x in rng.choice(topics[t], 32, replace=False)) for t in of], 8)
    a = plain_rows(space, idf)
    plain, latent = a @ a.T, space.latent @ space.latent.T
    same = np.equal.outer(of, of) & ~np.eye(60, dtype=bool)
    assert latent[same].mean() > 0.9 > 0.5 > plain[same].mean() and np.abs(latent - plain).max() > 0.5
    assert np.allclose(np.diag(latent), 1, atol=1e-4)


def test_judge():
    item = list(range(40))
    assert decontaminate.judge(item, [99, *item, 98])[1] == "copy"
    cut = [x for x in item if x % 3]  # two thirds of the words, the answer broken up
    assert decontaminate.judge(item, cut)[1] is None
    kept = [x if x % 3 or x >= 32 else 100 + x for x in item]
    assert decontaminate.judge(item, kept)[1] == "paraphrase"
    assert decontaminate.judge([1, 2, 3], [1, 9, 2, 3])[1] is None and decontaminate.judge([1, 2, 3], [0, 1, 2, 3])[1] == "copy"
    assert decontaminate.judge([], [1]) == (0.0, None)


def pairs(docs, benchmark):
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()}


def brute(docs, items):
    out = set()
    for d, text in docs:
        t = words([text])[0].tolist()
        for i, item in items:
            w = words([item])[0].tolist()
            if any(decontaminate.judge(w, t[a:a + 2 * len(w)])[1] for a in range(0, max(1, len(t)), max(1, len(w) // 4))):
                out.add((d, i))
    return out


def test_planted(spark):
    rng = np.random.default_rng(2)
    text = lambda n: [f"w{x}" for x in rng.zipf(1.2, n) % 20000]
    items = {i: text(int(rng.integers(8, 90))) for i in range(60)}
    docs, want = {}, set()
    for d in range(150):
        docs[d] = text(int(rng.integers(30, 900)))
        if d % 3 == 0:
            i = int(rng.integers(0, 60))
            inserted = list(items[i])
            if d % 2 and len(inserted) > 30:  # a paraphrase: a tenth of the words changed
                for k in rng.integers(0, len(inserted), len(inserted) // 10):
                    inserted[k] = f"p{rng.integers(0, 10 ** 6)}"
            at = int(rng.integers(0, len(docs[d])))
            docs[d][at:at] = inserted
            want.add((d, i))
    rows, bench = [(d, " ".join(w)) for d, w in docs.items()], [(i, " ".join(w)) for i, w in items.items()]
    got = pairs(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3),
                spark.createDataFrame(bench, "item_id bigint, text string"))
    assert len(got & want) >= 0.97 * len(want) and not got - want - brute(rows, bench)


def test_recall_by_length(spark):
    """Items of 10 to 500 words, some thirty passages for the longest: verbatim and with 30 % of the words before the answer changed."""
    rng = np.random.default_rng(4)
    text = lambda n: [f"w{x}" for x in rng.zipf(1.25, n) % 50000]
    lengths = [10, 20, 33, 50, 100, 200, 300, 500]
    items = [text(lengths[i % 8]) for i in range(120)]
    rows, want = [], {}
    for i, item in enumerate(items):
        for kind in (0, 1):
            inserted, n = list(item), len(item)
            if kind:
                for k in rng.choice(n - max(3, n // 5), int(0.3 * n), replace=False):
                    inserted[k] = f"p{rng.integers(0, 10 ** 6)}"
            rows.append((2 * i + kind, " ".join(text(300) + inserted + text(300))))
            want.setdefault((n, kind), set()).add((2 * i + kind, i))
    got = pairs(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5),
                spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string"))
    recall = {k: len(got & v) / len(v) for k, v in want.items()}
    assert all(r >= (0.9 if kind else 1.0) for (_, kind), r in recall.items()), recall


def test_short_items(spark):
    """Items of 1 to 24 words inside long documents: what brute force finds is found, verbatim or a paraphrase with the answer."""
    rng = np.random.default_rng(6)
    text = lambda n: [f"w{x}" for x in rng.zipf(1.3, n) % 20000]
    items = {i: text(i % 24 + 1) for i in range(72)}
    docs, want = {}, set()
    for d in range(144):
        i = d % 72
        inserted = list(items[i])
        if d >= 72 and len(inserted) >= 8:  # 30 % of the words before the answer changed
            n = len(inserted)
            for k in rng.choice(n - max(3, n // 5), int(0.3 * n), replace=False):
                inserted[k] = f"p{rng.integers(0, 10 ** 6)}"
        docs[d] = text(200)
        at = int(rng.integers(0, 200))
        docs[d][at:at] = inserted
        want.add((d, i))
    rows, bench = [(d, " ".join(w)) for d, w in docs.items()], [(i, " ".join(w)) for i, w in items.items()]
    got = pairs(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3),
                spark.createDataFrame(bench, "item_id bigint, text string"))
    assert got >= want | brute(rows, bench)


def test_edges(spark, edges, no_docs):
    bench = [(1, "one two"), (2, None), (3, ""), (None, "one two"), (4, "..."), (5, "two"), (6, "nobody in the old harbour town could say"),
             (1, "one two")]
    benchmark = spark.createDataFrame([(*b, "x", 1) for b in bench], "item_id bigint, text string, block string, word int")
    got = pairs(edges, benchmark)
    assert got == {(8, 1), (8, 5), (1, 6), (2, 6), (10, 6)}
    assert pairs(edges, benchmark.limit(0)) == set() and pairs(no_docs, benchmark) == set()


def test_parts(spark, edges, monkeypatch):
    """A benchmark in many parts gives what one gives."""
    benchmark = spark.createDataFrame([(k, f"old harbour town could say {k} why the lanterns had burned blue") for k in range(30)],
                                      "item_id bigint, text string")
    one = pairs(edges, benchmark)
    monkeypatch.setattr(decontaminate, "PART_CHARS", 600)
    assert pairs(edges, benchmark) == one and one


@needs_data
def test_recall_on_documents(spark, documents):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = pairs(documents, benchmark)
    want = brute([(r["doc_id"], r["text"]) for r in documents.collect()], [(r["item_id"], r["text"]) for r in benchmark.collect()])
    assert len(got & want) >= 0.9 * len(want) and not got - want
