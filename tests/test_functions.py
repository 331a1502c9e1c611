import math
import os
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.functions import paths as PATH
from foldwright.functions import probs as P
from foldwright.functions import vectors as V

NAN = float("nan")


def one(spark, value, kind, **cols):
    df = spark.createDataFrame([(value,)], f"p {kind}")
    return df.select(*[c.alias(n) for n, c in cols.items()]).first()


@pytest.mark.parametrize("p", [[0.7, 0.2, 0.1], [0.4, 0.4, 0.2], [0.1, 0.45, 0.45], [0.2, NAN, 0.9], [1 / 3] * 3])
def test_argmax_is_numpys(spark, p):
    r = one(spark, p, "array<double>", a=P.argmax("p"))
    assert r["a"] == int(np.argmax(p))


def test_argmax_of_columns(spark):
    r = one(spark, [0.3, 0.3, 0.1], "array<double>", a=P.argmax_of(P.entries("p", 3)),
            b=P.scale_argmax("p", [1.0, 1.0, 4.0]))
    assert (r["a"], r["b"]) == (0, 2)


def test_margin_and_tops(spark):
    r = one(spark, [0.7, 0.2, 0.1], "array<double>", m=P.margin("p"), a=P.top1("p"), b=P.top2("p"))
    assert r["m"] == pytest.approx(0.5) and (r["a"], r["b"]) == (0.7, 0.2)


def test_entropies(spark):
    for p, want in (([1.0, 0.0, 0.0], 0.0), ([1 / 3] * 3, math.log(3))):
        r = one(spark, p, "array<double>", n=P.entropy_norm("p"), c=P.entropy_clip("p"))
        assert r["n"] == pytest.approx(want, abs=1e-12) and r["c"] == pytest.approx(want, abs=1e-9)
    r = one(spark, [2.0, 1.0, 1.0], "array<double>", n=P.entropy_norm("p"), c=P.entropy_clip("p"))
    assert r["n"] == pytest.approx(1.5 * math.log(2)) and r["c"] == pytest.approx(0.0)


def test_label_quality_out_of_range_is_null(spark):
    r = one(spark, [0.7, 0.2, 0.1], "array<double>", a=P.label_quality("p", F.lit(1)), b=P.label_quality("p", F.lit(7)))
    assert (r["a"], r["b"]) == (0.2, None)


def test_softmax(spark):
    x = [1000.0, 1001.0, 999.0]
    e = np.exp(np.array(x) - 1001)
    assert one(spark, x, "array<double>", s=P.softmax("p"))["s"] == pytest.approx(list(e / e.sum()))


def test_blends(spark):
    r = one(spark, [0.6, 0.4, 0.0], "array<double>",
            m=P.mean_probs(["p", F.array(F.lit(0.0), F.lit(0.4), F.lit(0.6))]),
            b=P.blend_probs(["p", F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))], [0.25, 0.75]))
    assert r["m"] == pytest.approx([0.3, 0.4, 0.3]) and r["b"] == pytest.approx([0.15, 0.1, 0.75])


def test_linspace_is_numpys():
    assert P.linspace(0.5, 2.0, 30) == np.linspace(0.5, 2.0, 30).tolist()
    assert P.linspace(0.5, 2.0, 1) == [0.5]


def test_half_even(spark):
    for x in (2.0005, 0.8125, 1.3335, 1.7777):
        want = float(Decimal(repr(x)).quantize(Decimal("0.001"), ROUND_HALF_EVEN))
        assert one(spark, x, "double", h=P.half_even("p", 3))["h"] == want


def test_names(spark):
    r = one(spark, 1, "int", n=P.class_name("p", ["a", "b"]), i=P.class_id(F.lit("b"), ["a", "b"]),
            u=P.class_name(F.lit(9), ["a", "b"]), v=P.class_id(F.lit("z"), ["a", "b"]))
    assert tuple(r) == ("b", 1, "?", None)


@pytest.mark.parametrize("path", ["/a/b", "/a//b/", "/a/./b/../c", "a/../../b", "/../x", ".", "", "a/b/..", "../..", "/", "a//./b"])
def test_normalize_path(spark, path):
    assert one(spark, path, "string", p=PATH.normalize_path("p"))["p"] == os.path.normpath(path)


def test_path_parts(spark):
    r = one(spark, "/drive/train/x/IMG.JPeG", "string", s=PATH.suffix("p"), f=PATH.file_name("p"),
            r=PATH.rebase("p", "/drive/train", "/local/"), k=PATH.rebase("p", "/drive/tra", "/local"),
            n=PATH.suffix(F.lit("/x.d/file")))
    assert tuple(r) == ("jpeg", "IMG.JPeG", "/local/x/IMG.JPeG", "/drive/train/x/IMG.JPeG", "")


@pytest.mark.parametrize("h", ["0000000000000001", "ffffffffffffffff", "8000000000000000", "00ff00ff12345678"])
def test_hex(spark, h):
    r = one(spark, h, "string", b=PATH.hex_to_bits("p"), h=PATH.bits_to_hex(PATH.hex_to_bits("p")),
            d=PATH.hamming(PATH.hex_to_bits("p"), F.lit(0).cast("bigint")))
    word = int(h, 16)
    assert r["b"] == word - (1 << 64 if word >> 63 else 0) and r["h"] == h and r["d"] == bin(word).count("1")


def test_l2norm(spark):
    r = one(spark, [3.0, 4.0], "array<float>", n=V.l2norm("p"), z=V.l2norm(F.array(F.lit(0.0), F.lit(0.0))))
    assert r["n"] == pytest.approx([0.6, 0.8]) and r["z"] == [0.0, 0.0]


def test_blocks_weigh_the_same(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=4).tolist(), (rng.normal(size=6) * 1000).tolist()
    r = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(V.concat_features(["a", "b"])).first()[0]
    assert len(r) == 10
    assert np.linalg.norm(r[:4]) == pytest.approx(1) and np.linalg.norm(r[4:]) == pytest.approx(1)


def test_vector_sums(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 6.0])], "a array<double>, b array<double>")
    r = df.select(V.vec_mean(["a", "b"]).alias("m"), V.vec_sum(["a", "b"], [2.0, 0.5]).alias("s"),
                  V.cosine("a", "b").alias("c"), V.cosine("a", F.array(F.lit(0.0), F.lit(0.0))).alias("z")).first()
    assert r["m"] == [2.0, 4.0] and r["s"] == [3.5, 7.0] and r["c"] == pytest.approx(1) and r["z"] == 0


def test_finite(spark):
    for v, ok in (([1.0], True), ([NAN], False), ([math.inf], False), ([None], False)):
        assert one(spark, v, "array<double>", f=V.is_finite("p"))["f"] is ok
