import numpy as np
import pytest
from cases import prob_rows
from pyspark.sql import functions as F

from foldwright.operators import diagnosis, label_noise


def brute(p, y, frac=0.1, both=False, k=3):
    t = np.array([p[y == c, c].mean() if (y == c).any() else np.inf for c in range(k)])
    joint = np.zeros((k, k))
    for row, label in zip(p, y):
        ok = [j for j in range(k) if row[j] >= t[j]]
        if ok:
            joint[label, max(ok, key=lambda j: (row[j], -j))] += 1
    hit, low = np.zeros(len(y), bool), np.zeros(len(y), bool)
    for s in range(k):
        mine = np.where(y == s)[0]
        joint[s] = joint[s] * len(mine) / joint[s].sum() if joint[s].sum() else 0
        total = 0
        for j in range(k):
            n = min(int(round(frac * joint[s, j])), max(len(mine) - 1 - total, 0)) if j != s else 0
            if n > 0:
                total += n
                gap = p[mine, j] - p[mine, s]
                hit[mine[gap >= np.sort(gap)[-n]]] = True
        if total:
            q = p[mine, s]
            low[mine[q <= np.sort(q)[total - 1]]] = True
    hit &= p.argmax(1) != y
    return set(np.where(hit & low if both else hit)[0].tolist())


@pytest.mark.parametrize("both", [False, True])
@pytest.mark.parametrize("frac", [0.1, 1.0])
def test_equals_brute_force(random_probs, both, frac):
    df, y, _, p = random_probs
    got = label_noise.confident_learning(df, filter_by="both" if both else "prune_by_noise_rate", frac_noise=frac)
    rows = got.collect()
    assert {r["key"] for r in rows} == brute(p, y, frac, both)
    cut = np.percentile([r["quality"] for r in rows], 25)
    for r in rows:
        assert r["quality"] == p[r["key"], y[r["key"]]] and r["is_high_priority"] == (r["quality"] <= cut)
        assert r["label"] != r["pred_class"] and r["confidence"] == p[r["key"]].max()


def test_planted_noise_is_found(spark):
    rng = np.random.default_rng(42)
    truth = np.arange(200) % 3
    p = np.full((200, 3), 0.02)
    p[np.arange(200), truth] = 0.96
    p += rng.random((200, 3)) * 0.01
    p /= p.sum(1, keepdims=True)
    label = truth.copy()
    flipped = rng.choice(200, 10, replace=False)
    label[flipped] = (label[flipped] + 1) % 3
    df = prob_rows(spark, [(i, int(label[i]), i % 5, p[i].tolist()) for i in range(200)])
    found = {r["key"] for r in label_noise.confident_learning(df, frac_noise=1.0).collect()}
    assert found == set(flipped.tolist())


def test_partitioning_does_not_matter(random_probs):
    df = random_probs[0]
    runs = [sorted(map(tuple, label_noise.confident_learning(df.repartition(n)).collect())) for n in (1, 17)]
    assert runs[0] == runs[1] and runs[0]


def test_unknown_filter(random_probs):
    with pytest.raises(ValueError):
        label_noise.confident_learning(random_probs[0], filter_by="other")


def test_ambiguous_is_strict(spark):
    """Rows exactly at a threshold stay out."""
    rows = [(0, 0, 0, [0.5, 0.3, 0.2]), (1, 0, 0, [0.4, 0.35, 0.25]), (2, 2, 0, [0.9, 0.05, 0.05])]
    diag = diagnosis.diagnose(prob_rows(spark, rows)).cache()
    at = {r["key"]: r for r in diag.collect()}
    m, e = at[0]["margin"], at[0]["entropy"]
    got, _, _ = diagnosis.filter_ambiguous(diag, m, e)
    assert {r["key"]: r["source"] for r in got.collect()} == {1: "both"}
    got, _, _ = diagnosis.filter_ambiguous(diag, m, 99.0)
    assert [r["source"] for r in got.collect()] == ["low_margin"]
    got, _, _ = diagnosis.filter_ambiguous(diag, 1.0, 99.0)
    by = {r["key"]: (r["pair"], r["is_priority_pair"]) for r in got.collect()}
    assert by[2] == ("Organic→Recyclable", True) and by[1] == ("Recyclable (correct, low margin)", False)


def test_auto_thresholds(random_probs):
    df = random_probs[0]
    diag = diagnosis.diagnose(df)
    pdf = diag.toPandas()
    got, low, high = diagnosis.filter_ambiguous(diag)
    assert low == np.percentile(pdf["margin"], 5) and high == np.percentile(pdf["entropy"], 95)
    want = pdf[(pdf["margin"] < low) | (pdf["entropy"] > high)]
    assert {r["key"] for r in got.collect()} == set(want["key"])


def test_cap_halves_the_percentile_once(random_probs):
    diag = diagnosis.diagnose(random_probs[0])
    rows, report = diagnosis.ambiguous_with_cap(diag, cap_pct=0.1)
    assert report["pct"] == 2.5 and not report["within_cap"] and rows.count() == report["n"] > 0
    rows, report = diagnosis.ambiguous_with_cap(diag, cap_pct=50)
    assert report["pct"] == 5.0 and report["within_cap"]


def test_margin_issues(random_probs):
    diag = diagnosis.diagnose(random_probs[0])
    rows = diagnosis.margin_issues(diag).collect()
    assert rows and all(r["is_correct"] == 0 and r["margin"] < 0.15 for r in rows)
    assert [r["margin"] for r in rows] == sorted(r["margin"] for r in rows)
    assert all(r["is_high_priority"] == (r["margin"] < 0.075) for r in rows)
    assert [r["key"] for r in diagnosis.margin_issues(diag, top_n=4).collect()] == [r["key"] for r in rows[:4]]


def test_double_flag_and_pairs(random_probs):
    df = random_probs[0]
    amb = diagnosis.filter_ambiguous(diagnosis.diagnose(df))[0]
    issues = label_noise.confident_learning(df, frac_noise=1.0)
    flagged = diagnosis.flag_double(amb, issues)
    keys = {r["key"] for r in issues.collect()}
    assert all(r["is_double_flagged"] == (r["key"] in keys) for r in flagged.collect())
    pairs = diagnosis.pair_distribution(flagged).collect()
    assert sum(r["n"] for r in pairs) == amb.count()
    assert sum(r["double_flagged"] for r in pairs) == flagged.where("is_double_flagged").count()
    assert [r["n"] for r in pairs] == sorted((r["n"] for r in pairs), reverse=True)


def test_row_operators_run_on_a_stream(spark, random_probs, tmp_path):
    df = random_probs[0]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = (diagnosis.diagnose(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, diagnosis.diagnose(df).collect()))
    assert got.select(F.sum("is_correct")).first()[0] > 0
