import numpy as np
import pytest

from foldwright.operators import dedup, hamming


def hashes(spark, words, keys=None):
    rows = [(int(k), None if w is None else int(w)) for k, w in zip(keys or range(len(words)), words)]
    return spark.createDataFrame(rows, "key bigint, hash bigint")


def star(rows, t):
    """Sequential greedy in key order."""
    root = {}
    for k, h in sorted(rows):
        if k in root:
            continue
        root[k] = k
        if h is None:
            continue
        for k2, h2 in rows:
            if k2 not in root and h2 is not None and bin((h ^ h2) & (2**64 - 1)).count("1") <= t:
                root[k2] = k
    return root


def components(rows, t):
    root = {k: k for k, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, h in rows:
            for b, g in rows:
                if h is not None and g is not None and bin((h ^ g) & (2**64 - 1)).count("1") <= t and root[b] < root[a]:
                    root[a] = root[b]
                    changed = True
    return root


def test_path_tells_star_from_components(spark):
    df = hashes(spark, [0b0000, 0b0011, 0b1111])
    assert {r["key"]: r["root"] for r in dedup.near_duplicates(df, 2, "star").collect()} == {0: 0, 1: 0, 2: 2}
    assert {r["key"]: r["root"] for r in dedup.near_duplicates(df, 2, "components").collect()} == {0: 0, 1: 0, 2: 0}


@pytest.mark.parametrize("t", [0, 1, 2, 3, 4, 6, 9, 16])
@pytest.mark.parametrize("mode", ["star", "components"])
def test_equals_brute_force(spark, t, mode):
    rng = np.random.default_rng(t)
    words = []
    for _ in range(14):  # random walks: chains of close hashes, with exact copies
        w = int(rng.integers(-2**62, 2**62))
        for _ in range(int(rng.integers(1, 9))):
            words.append(w)
            for b in rng.choice(64, int(rng.integers(0, max(4, t + 2))), replace=False):
                w ^= 1 << int(b)
            w = (w + (1 << 63)) % (1 << 64) - (1 << 63)
    words += [None, None]
    keys = rng.permutation(len(words)).tolist()
    df = hashes(spark, words, keys).repartition(3)
    got = {r["key"]: r["root"] for r in dedup.near_duplicates(df, t, mode).collect()}
    rows = list(zip(keys, words))
    want = star(rows, t) if mode == "star" else components(rows, t)
    assert got == want


def test_sign_bit(spark):
    df = hashes(spark, [-1, -1 ^ (1 << 62), 0, -(1 << 63)])
    got = {r["key"]: r["root"] for r in dedup.near_duplicates(df, 1, "components").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2}


@pytest.mark.parametrize("t", range(1, 17))
def test_near_words_meet_in_a_bucket(t):
    """Whatever bits differ, one band differs by at most one bit from either side."""
    rng = np.random.default_rng(t)
    cut = hamming.bands(t, 64)
    assert sum(w for _, w in cut) == 64 and [a for a, _ in cut] == list(np.cumsum([0] + [w for _, w in cut])[:-1])
    for _ in range(300):
        flipped = rng.choice(64, t, replace=False)
        assert min(np.isin(flipped, range(a, a + w)).sum() for a, w in cut) <= (0 if t <= 3 else 2)


@pytest.mark.parametrize("t", [1, 2, 5, 9])
def test_crowded_buckets_are_split(spark, monkeypatch, t):
    """Words that share most bits: listed anew by the other bits, then in pairs of blocks; nothing is lost."""
    monkeypatch.setattr(hamming, "BUCKET", 12)
    rng = np.random.default_rng(t)
    words = [int(x) for x in rng.integers(0, 1 << 11, 150) << 3] + [int(x) for x in rng.integers(-2**62, 2**62, 30)]
    keys = rng.permutation(len(words)).tolist()
    df = hashes(spark, words, keys)
    for mode, plain in (("star", star), ("components", components)):
        assert {r["key"]: r["root"] for r in dedup.near_duplicates(df, t, mode).collect()} == plain(list(zip(keys, words)), t)


def test_lists_stay_short(spark):
    point = spark.createDataFrame([(-5,)], "h bigint")
    for t in range(1, 17):
        n = hamming._buckets(point, t).count()
        assert n == t + 1 if t <= 3 else n <= 70


def test_exact_groups(spark):
    df = hashes(spark, [7, 8, 7, None, None, 9, 9, 9])
    groups = {r["hash"]: (r["n"], r["first_key"]) for r in dedup.duplicate_groups(df).collect()}
    assert groups == {7: (2, 0), 9: (3, 5)}
    s = dedup.duplicate_summary(df).first()
    assert (s["duplicate_groups"], s["duplicate_total"], s["largest"], s["need_group_split"]) == (2, 5, 3, True)
    members = {}
    for r in dedup.duplicate_members(df).collect():
        members.setdefault(r["hash"], set()).add(r["key"])
    assert members == {7: {0, 2}, 9: {5, 6, 7}}
    ids = {r["key"]: r["group_id"] for r in dedup.assign_group_ids(df).collect()}
    assert ids == {5: 0, 6: 0, 7: 0, 0: 1, 2: 1, 1: 2, 3: 3, 4: 4}
    assert not dedup.duplicate_summary(df.where("key = 1")).first()["need_group_split"]


def test_near_groups_count(spark):
    df = hashes(spark, [0, 1, 1 << 40, 12345678901])
    assert [tuple(r) for r in dedup.near_duplicate_groups(df, 1).collect()] == [(0, 3)]


def test_bad_options(spark):
    df = hashes(spark, [1])
    with pytest.raises(ValueError):
        dedup.near_duplicates(df, 17)
    with pytest.raises(ValueError):
        dedup.near_duplicates(df, 1, "other")


def _star_by_hand(hashes, t):
    root = {}
    for key in sorted(hashes):
        if key not in root:
            for other in sorted(hashes):
                if other not in root and bin((hashes[key] ^ hashes[other]) & (2 ** 64 - 1)).count("1") <= t:
                    root[other] = key
    return root


def test_a_long_chain_takes_no_rounds(spark, monkeypatch):
    """1000 ascending keys, each within reach of the next only: one group per task, no round per key."""
    monkeypatch.setattr(dedup, "_star_rounds", lambda *a: pytest.fail("rounds were taken"))
    word, chain = 0, {}
    for key in range(1000):
        word ^= 1 << ((key * 7) % 61)
        chain[key] = word - (1 << 64) if word >= 1 << 63 else word
    df = spark.createDataFrame(list(chain.items()), "key bigint, hash bigint")
    got = {r["key"]: r["root"] for r in dedup.near_duplicates(df, 1).collect()}
    first = {}
    for key in sorted(chain):
        first.setdefault(chain[key], key)
    by_hand = _star_by_hand({k: h for h, k in first.items()}, 1)
    assert got == {k: by_hand[first[h]] for k, h in chain.items()}


def test_large_components_take_rounds(spark, monkeypatch):
    rng = np.random.default_rng(0)
    hashes = {k: int(x) for k, x in enumerate(rng.integers(0, 1 << 9, 300))}
    df = spark.createDataFrame(list(hashes.items()), "key bigint, hash bigint")
    one = {r["key"]: r["root"] for r in dedup.near_duplicates(df, 2).collect()}
    monkeypatch.setattr(dedup, "STAR_GROUP", 3)
    assert {r["key"]: r["root"] for r in dedup.near_duplicates(df, 2).collect()} == one
