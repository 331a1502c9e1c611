import math
import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from foldwright.sources import images
from foldwright.streaming import ingest
from foldwright.sources.tables import is_complete, read_versioned

LABELS = {"0_A": 0, "1_B": 1}
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # encoders below run in workers


def save(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)


@pytest.fixture(scope="module")
def tree(tmp_path_factory, make_png):
    root = tmp_path_factory.mktemp("corpus")
    rng = np.random.default_rng(0)
    base = np.kron(rng.integers(10, 240, (8, 6)), np.ones((8, 8), dtype=int))
    files = {
        "0_A/a.png": make_png(base), "0_A/copy.PNG": make_png(base),
        "0_A/near.png": make_png(np.clip(base + rng.integers(0, 2, base.shape), 0, 255)),
        "1_B/rgb.png": make_png(rng.integers(0, 256, (20, 30, 3))),
        "1_B/rgba.png": make_png(rng.integers(0, 256, (16, 16, 4))),
        "1_B/broken.png": make_png(base)[:60], "1_B/notes.txt": b"no image",
    }
    for name, content in files.items():
        save(str(root / name), content)
    return str(root)


def name(path):
    return path.rsplit("/", 1)[-1]


def test_scan(spark, tree):
    rows = {name(r["path"]): (r["label_name"], r["label"]) for r in images.scan_labelled(spark, tree, LABELS).collect()}
    assert rows == {"a.png": ("0_A", 0), "copy.PNG": ("0_A", 0), "near.png": ("0_A", 0), "rgb.png": ("1_B", 1),
                    "rgba.png": ("1_B", 1), "broken.png": ("1_B", 1)}
    plan = images.scan_labelled(spark, tree, LABELS)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan  # listing does not read the files
    with pytest.raises(FileNotFoundError):
        images.scan_labelled(spark, tree, {**LABELS, "2_C": 2})
    listed = images.scan_unlabelled(spark, tree).collect()
    assert [r["path"] for r in listed] == sorted(r["path"] for r in listed) and len(listed) == 6


def test_health_and_stats(spark, tree):
    health = images.image_health(images.read_pixels(spark, tree)).cache()
    assert [name(r["path"]) for r in images.skip_list(health).collect()] == ["broken.png"]
    stats = {name(r["path"]): tuple(r)[1:] for r in images.image_stats(health).collect()}
    assert stats["a.png"] == (48, 64, 1, 0.75) and stats["rgb.png"] == (30, 20, 3, 1.5) and len(stats) == 5
    assert images.image_stats(health, sample_n=3).count() <= 3


def test_pixels(spark, tree):
    seen = {name(r["path"]): tuple(r)[1:] for r in images.inspect(images.read_pixels(spark, tree)).collect()}
    assert seen["broken.png"] == (False, None, None, None, None) and seen["rgba.png"][3] == 4
    assert seen["a.png"][:4] == (True, 48, 64, 1)


def save_jpeg(spark, path, value=(200, 100, 50)):
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(24, 16, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for x in range(24):
        for y in range(16):
            picture.setRGB(x, y, value[0] * 65536 + value[1] * 256 + value[2])
    os.makedirs(os.path.dirname(path), exist_ok=True)
    assert jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(path))


def test_jpeg(spark, tmp_path):
    save_jpeg(spark, str(tmp_path / "x.jpg"))
    content = images.read_pixels(spark, str(tmp_path))
    r = images.inspect(content).first()
    assert (r["ok"], r["width"], r["height"], r["channels"]) == (True, 24, 16, 3)
    pixels = images.decode_pixels(content.first()["content"])
    assert np.abs(pixels.reshape(-1, 3).mean(0) - [200, 100, 50]).max() < 4


def test_phash(spark, tree):
    h = {name(r["path"]): r["phash"] for r in images.phash64(images.read_pixels(spark, tree)).collect()}
    assert h["a.png"] == h["copy.PNG"] and h["broken.png"] is None

    def distance(a, b):
        return bin((h[a] ^ h[b]) & (2**64 - 1)).count("1")

    assert distance("a.png", "near.png") <= 6 < distance("a.png", "rgb.png")


def mean_encoder():
    return lambda pictures: np.array([[p.mean(), 1.0] for p in pictures])


def test_encode_averages_views(spark, tmp_path, make_png):
    for v in (0, 50, 200):
        save(str(tmp_path / f"{v}.png"), make_png(np.full((4, 4), v)))
    rows = images.encode(images.read_pixels(spark, str(tmp_path)), mean_encoder, [lambda p: p * 0 + 100], batch=2)
    got = {name(r["path"]): r["vec"] for r in rows.collect()}
    assert got == {"0.png": [50.0, 1.0], "50.png": [75.0, 1.0], "200.png": [150.0, 1.0]}


def test_encode_rejects_bad_output(spark, tmp_path, make_png):
    save(str(tmp_path / "x.png"), make_png(np.zeros((4, 4))))
    content = images.read_pixels(spark, str(tmp_path))
    with pytest.raises(Exception, match="finite"):
        images.encode(content, lambda: (lambda ps: np.full((len(ps), 2), np.nan))).collect()
    save(str(tmp_path / "y.png"), b"junk")
    with pytest.raises(Exception, match="unreadable"):
        images.encode(images.read_pixels(spark, str(tmp_path)), mean_encoder).collect()


def test_digest(spark, tree):
    import hashlib
    path = f"{tree}/0_A/a.png"
    with open(path, "rb") as f:
        want = hashlib.sha256(f.read()).hexdigest()[:16]
    assert images.file_digest(spark, [path]).first()["digest"] == want


def test_resume(spark, tmp_path, make_png):
    root, out, cp = (str(tmp_path / d) for d in ("in", "out", "cp"))
    for v in range(5):
        save(f"{root}/{v}.png", make_png(np.full((4, 4), v)))

    def run():
        return {name(r["path"]): r["vec"][0] for r in
                ingest.encode_resumable(spark, root, out, cp, mean_encoder, files_per_batch=2).collect()}

    assert run() == {f"{v}.png": float(v) for v in range(5)}
    parts = sorted(os.listdir(out))
    assert len(run()) == 5 and sorted(os.listdir(out)) == parts  # nothing new, nothing written
    save(f"{root}/9.png", make_png(np.full((4, 4), 9)))
    assert run()["9.png"] == 9.0 and len(run()) == 6


def test_resume_after_a_failure(spark, tmp_path, make_png):
    root, out, cp = (str(tmp_path / d) for d in ("in", "out", "cp"))
    for v in range(6):
        save(f"{root}/{v}.png", make_png(np.full((4, 4), v)))
    marker = str(tmp_path / "fail")
    save(marker, b"")

    def flaky():
        def model(pictures):
            if os.path.exists(marker) and any(p.mean() == 4 for p in pictures):
                raise RuntimeError("lost")
            return np.array([[p.mean()] for p in pictures])
        return model

    with pytest.raises(Exception, match="lost"):
        ingest.encode_resumable(spark, root, out, cp, flaky, files_per_batch=2)
    os.replace(marker, marker + ".off")
    rows = ingest.encode_resumable(spark, root, out, cp, flaky, files_per_batch=2).collect()
    assert sorted(r["vec"][0] for r in rows) == [float(v) for v in range(6)]


def test_extract_all_skips_finished(spark, tmp_path, make_png):
    root = str(tmp_path / "in")
    for v in range(3):
        save(f"{root}/{v}.png", make_png(np.full((4, 4), v)))
    jobs = {"plain": (root, mean_encoder, ()), "dark": (root, mean_encoder, (lambda p: p * 0,))}
    paths = ingest.extract_all(spark, jobs, str(tmp_path / "sets"))
    assert all(is_complete(spark, p) for p in paths.values())
    before = sorted(os.listdir(paths["plain"]))
    ingest.extract_all(spark, jobs, str(tmp_path / "sets"))
    assert sorted(os.listdir(paths["plain"])) == before
    assert sorted(r["vec"][0] for r in read_versioned(spark, paths["dark"])[0].collect()) == [0.0, 0.5, 1.0]


@pytest.mark.parametrize("paths,want", [
    (["/a/b/c/1.png", "/a/b/d/2.png"], "/a/b"), (["/a/b/1.png", "/a/b/2.png"], "/a/b"), (["/a/bc/1.png", "/a/bd/1.png"], "/a"),
    (["/a/b/1.png", "/a/b/c/2.png"], "/a/b"), (["/x/1.png", "/y/1.png"], "")])
def test_common_root(spark, paths, want):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert images.common_root(df) == want


def test_resume_over_jpeg_and_png(spark, tmp_path, make_png):
    """Defaults encode both formats; a decoder of one's own gets the bytes."""
    root = str(tmp_path / "in")
    save(f"{root}/a.png", make_png(np.full((4, 4), 7)))
    save_jpeg(spark, f"{root}/sub/b.JPG", (90, 90, 90))
    save(f"{root}/notes.txt", b"no image")

    def run(out):
        rows = ingest.encode_resumable(spark, root, str(tmp_path / out), str(tmp_path / f"{out}-cp"), mean_encoder).collect()
        return {name(r["path"]): r["vec"][0] for r in rows}

    got = run("one")
    assert set(got) == {"a.png", "b.JPG"} and got["a.png"] == 7 and abs(got["b.JPG"] - 90) < 2
    save_jpeg(spark, f"{root}/c.jpeg", (10, 10, 10))
    assert set(run("one")) == {"a.png", "b.JPG", "c.jpeg"}
    sizes = ingest.encode_resumable(spark, root, str(tmp_path / "two"), str(tmp_path / "two-cp"), mean_encoder, (),
                                    lambda content: np.full((1, 1, 1), len(content) % 251))
    assert sizes.count() == 3


def _slow_shrink(grey, size):
    """The filter pixel by pixel: a windowed sinc of three taps to either side, stretched by the scale, weights in 1 / 2**22."""
    def line(values):
        n, out = len(values), []
        scale = n / size
        stretch = max(scale, 1.0)
        for i in range(size):
            centre = (i + 0.5) * scale
            first, last = max(int(centre - 3 * stretch + 0.5), 0), min(int(centre + 3 * stretch + 0.5), n)
            weights = []
            for j in range(first, last):
                x = (j - centre + 0.5) / stretch
                pi = math.pi
                weights.append(0.0 if abs(x) > 3 else 1.0 if x == 0 else math.sin(pi * x) / (pi * x) * math.sin(pi * x / 3) / (pi * x / 3))
            total, sum_ = sum(weights), 1 << 21
            for w, j in zip(weights, range(first, last)):
                fixed = w / total * (1 << 22)
                sum_ += int(fixed + (0.5 if fixed >= 0 else -0.5)) * int(values[j])
            out.append(min(max(sum_ >> 22, 0), 255))
        return out

    rows = [line(r) if grey.shape[1] != size else list(r) for r in grey]
    columns = [line(c) if grey.shape[0] != size else list(c) for c in zip(*rows)]
    return np.array(list(zip(*columns)))


@pytest.mark.parametrize("shape", [(48, 37), (20, 90), (32, 64), (7, 5), (32, 32), (130, 33)])
def test_shrinking_equals_the_filter_by_definition(shape):
    rng = np.random.default_rng(sum(shape))
    for grey in (rng.integers(0, 256, shape), np.indices(shape).sum(axis=0) * 3 % 256, np.where(rng.random(shape) < 0.5, 0, 255)):
        assert (images.shrink(grey, 32) == _slow_shrink(grey, 32)).all()


def test_hash_by_definition():
    """Bits of the 8 x 8 lowest frequencies above their median, row by row, highest bit first; grey values in integers."""
    rng = np.random.default_rng(5)
    for shape in ((50, 41, 3), (33, 60, 4), (40, 40, 1)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        image = (image // 3 + 85 * np.indices(shape[:2]).sum(axis=0)[:, :, None] // 60 % 170).astype(np.uint8)
        if shape[2] >= 3:
            grey = np.array([[(19595 * int(p[0]) + 38470 * int(p[1]) + 7471 * int(p[2]) + 32768) >> 16 for p in row] for row in image])
        else:
            grey = image[:, :, 0].astype(int)
        small = _slow_shrink(grey, 32)
        low = [[sum(small[y][x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64)
                    for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
        middle = sorted(x for row in low for x in row)
        middle = (middle[31] + middle[32]) / 2
        bits = "".join(str(int(x > middle)) for row in low for x in row)
        assert images.phash_bits(image) % (1 << 64) == int(bits, 2)
