import threading

import numpy as np
import pytest
from test_knn import vec_rows

from foldwright.operators import heads, metrics
from foldwright.operators.vectors import l2_normalise


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(42)
    label, fold = np.arange(90) % 3, (np.arange(90) // 3) % 5
    return vec_rows(spark, rng.normal(0, 5, (3, 8))[label] + rng.normal(0, 0.3, (90, 8)), label, fold)


def accuracy(df):
    return metrics.with_pred(df).where("pred = label").count() / df.count()


def check(df, n, k=3):
    rows = df.collect()
    assert len(rows) == n
    for r in rows:
        assert len(r["probs"]) == k and sum(r["probs"]) == pytest.approx(1, abs=1e-5) and min(r["probs"]) >= 0


@pytest.mark.parametrize("head", ["linear", "knn", heads.make_mlp(32, 300), heads.make_trees(10, 4), "lgbm"])
def test_heads_learn_and_return_probabilities(blobs, head):
    out = heads.fit_predict(blobs, blobs, head, 3).cache()
    check(out, 90)
    assert accuracy(out) > 0.9


def test_cross_validation(blobs):
    for balanced in (False, True):
        oof = heads.cross_val_oof(blobs, "linear", 3, balanced=balanced)
        check(oof, 90)
        assert metrics.fold_consistency(metrics.with_pred(oof)).first()["min"] > 0.9


def test_linear_on_noise(spark):
    rng = np.random.default_rng(1)
    df = vec_rows(spark, rng.normal(size=(150, 6)), rng.integers(0, 3, 150), np.arange(150) % 5)
    assert accuracy(heads.cross_val_oof(df, "linear", 3)) < 0.6


def test_linear_matches_the_penalised_optimum(spark):
    """Gradient of sum(log loss) + |w|^2 / 2 (C = 1) vanishes at the solution."""
    rng = np.random.default_rng(2)
    y = np.arange(120) % 3
    x = rng.normal(0, 1, (3, 4))[y] + rng.normal(size=(120, 4))
    df = vec_rows(spark, x, y, np.zeros(120))
    model = heads.HEADS["linear"].fit(df, 3, 42, False)[None][0]
    w, b = model[:-1].T, model[-1]
    z = x @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    grad = (p - np.eye(3)[y]).T @ x + w
    assert np.abs(grad).max() < 1e-3 and np.abs((p - np.eye(3)[y]).sum(0)).max() < 1e-3


def test_absent_class_gets_zero(blobs):
    out = heads.fit_predict(blobs.where("label < 2"), blobs, "linear", 3)
    assert all(len(r["probs"]) == 3 and r["probs"][2] == 0 for r in out.collect())


def test_unknown_and_custom_heads(blobs):
    with pytest.raises(KeyError):
        heads.get_head("forest")
    heads.register_head("copy", heads.HEADS["linear"])
    try:
        assert heads.fit_predict(blobs, blobs, "copy", 3).count() == 90
    finally:
        del heads.HEADS["copy"]


def test_grid(blobs):
    rows = heads.probe_grid({"plain": blobs, "unit": l2_normalise(blobs)}, ["knn"], 3).collect()
    assert [r["combo"] for r in rows] and all(r["mean"] > 0.9 and r["min"] <= r["mean"] for r in rows)
    assert [r["mean"] for r in rows] == sorted((r["mean"] for r in rows), reverse=True)


def test_fits_of_a_grid_overlap(blobs):
    """Each of two fits waits until the other has begun."""
    both, linear = threading.Barrier(2, timeout=60), heads.HEADS["linear"]
    heads.register_head("met", heads.Head(linear.fit, linear.predict, lambda *a: both.wait() * 0 or linear.fit_folds(*a)))
    try:
        assert len(heads.probe_grid({"a": blobs, "b": blobs}, ["met"], 3).collect()) == 2
    finally:
        del heads.HEADS["met"]
