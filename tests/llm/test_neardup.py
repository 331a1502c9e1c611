"""Near-dedup against all pairs."""

import collections
import itertools

import numpy as np

from foldwright.llm import neardup
from foldwright.llm.shingles import shingles, words

from llm_cases import EDGES, needs_data


def classes(texts):
    """{row number: least doc_id of its component} for [(doc_id, text)] by comparing all pairs of different texts."""
    sh = shingles([t or "" for _, t in texts])
    n = sum(t is not None for _, t in texts)
    frequency = collections.Counter(x for (_, t), s in zip(texts, sh) if t is not None for x in set(s.tolist()))
    frequent = {x: f for x, f in frequency.items() if f >= neardup.least_frequent(n)}
    idf = neardup.Weights(np.array(list(frequent), dtype=np.uint64), np.array(list(frequent.values()), dtype=float), n)
    weights = [neardup.weighted(s, idf) for s in sh]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [set(w[0].tolist()) for w in weights]
    for a, b in itertools.combinations(range(len(texts)), 2):
        same = texts[a][1] is not None and texts[a][1] == texts[b][1]
        if same or (2 * len(sets[a] & sets[b]) > 0.5 * min(len(sets[a]), len(sets[b]))
                    and neardup.similarity(weights[a], weights[b]) >= neardup.SIMILARITY):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for k in range(len(texts)):
        groups.setdefault(root(k), []).append(texts[k][0])
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return [least[root(k)] for k in range(len(texts))]


def check(docs, texts):
    got = sorted(((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(docs).collect()), key=repr)
    assert got == sorted(((k, c) for (k, _), c in zip(texts, classes(texts))), key=repr)


def test_words_and_shingles():
    one, begin = words(["Ab, c_d  É!", "", "ab C_D é"])
    assert begin.tolist() == [0, 3, 3, 6] and (one[:3] == one[3:]).all() and len(set(one.tolist())) == 3
    a, b, c, d = shingles(["a b c d e f", "x b c d e f", "a b", ""])
    assert a[1] == b[1] and a[0] != b[0] and len(c) == 1 and len(d) == 0


def test_samples_estimate_similarity():
    rng = np.random.default_rng(3)
    features = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    wa, wb = rng.gamma(2, 1, 300).astype(np.float32), rng.gamma(2, 1, 300).astype(np.float32)
    a, b = (features[:300], wa), (features[100:], wb)
    order = np.argsort(a[0]), np.argsort(b[0])
    a, b = (a[0][order[0]], a[1][order[0]]), (b[0][order[1]], b[1][order[1]])
    sampler = neardup.Sampler(samples=3000)
    s = sampler(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, 300]))
    assert abs((s[0] == s[1]).mean() - neardup.jaccard(a, b)[0]) < 0.03


def test_groups_with_chains(spark):
    """Copies, near copies, chains of edits and a shared passage, in a table small enough for all pairs."""
    rng = np.random.default_rng(5)
    texts, common = [], [f"c{i}" for i in range(60)]
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 3000, 300)] + (common if g % 2 else [])
        for v in range(6):
            texts.append((len(texts) + 1, " ".join(base)))
            base = list(base)
            for at in rng.integers(0, len(base), 3):
                base[at] = f"e{rng.integers(0, 10 ** 6)}"
        texts.append((len(texts) + 1, texts[-1][1]))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    check(docs, texts)


def test_a_large_group_is_one_class(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [(k, " ".join(base[:k % 190] + [f"x{k}"] + base[k % 190 + 1:])) for k in range(600)] + [(1000, "something else entirely " * 9)]
    out = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r["class_id"] for r in out if r["doc_id"] < 600} == {0}
    assert [r["class_id"] for r in out if r["doc_id"] == 1000] == [1000]


def test_edges(edges, no_docs):
    check(edges, EDGES)
    assert neardup.near_duplicates(no_docs).collect() == []
    kept = neardup.keep_one(edges)
    assert kept.columns == edges.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert len(rows) == len(set(rows)) and (1, EDGES[0][1]) in rows and (2, EDGES[0][1]) not in rows
    assert (3, None) in rows and (None, None) in rows and (10, "another text with id ten") in rows
    assert neardup.keep_one(no_docs).collect() == []


def test_components(spark):
    rng = np.random.default_rng(7)
    chain = [(k, k + 1) for k in range(300)]
    links = chain + [(1000, k) for k in range(1001, 1200)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2060, (40, 2))]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for x in list(parent)}


@needs_data
def test_documents(documents):
    check(documents, [(r["doc_id"], r["text"]) for r in documents.collect()])


def test_weights_follow_true_frequencies(spark):
    """Rare and common shingles differ although there are far more shingles than cells."""
    rng = np.random.default_rng(3)
    common = [" ".join(f"c{i}w{k}" for k in range(5)) for i in range(4)]
    rows = []
    for i in range(1200):
        body = " ".join(f"w{x}" for x in rng.integers(0, 10 ** 7, 400))
        rows.append((" ".join(common[k] for k in range(4) if i % (2 ** (k + 1)) == 0) + " . " + body,))
    texts = spark.createDataFrame(rows, "text string").repartition(6)
    kept = neardup.FREQUENCY_BITS
    idf = neardup.shingle_weights(texts, 1200)
    assert 1200 * 390 > 1 << kept
    found = [float(idf(shingles([c])[0])[0]) for c in common]
    want = [1 + 0.5 * np.log1p(2.0 ** (k + 1)) / np.log1p(1200) for k in range(4)]
    assert np.allclose(found, want, atol=1e-3)
    rare = idf(shingles([rows[0][0].split(" . ")[1]])[0])
    assert (rare == np.float32(1.5)).all() and max(found) < 1.22
