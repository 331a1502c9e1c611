import os
import struct
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cases import prob_rows  # noqa: E402
from foldwright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 4)


def png(image: np.ndarray, line_filter: int = 0) -> bytes:
    """Minimal PNG writer for grey, RGB and RGBA arrays."""
    image = np.asarray(image, dtype=np.uint8)
    if image.ndim == 2:
        image = image[:, :, None]
    h, w, bands = image.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[bands]
    lines, above = [], np.zeros(w * bands, dtype=np.int64)
    for row in image.reshape(h, w * bands).astype(np.int64):
        left = np.concatenate([np.zeros(bands, dtype=np.int64), row[:-bands]])
        corner = np.concatenate([np.zeros(bands, dtype=np.int64), above[:-bands]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left,
                         np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][line_filter]
        lines.append(bytes([line_filter]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b""))


@pytest.fixture(scope="session")
def make_png():
    return png


@pytest.fixture(scope="session")
def random_probs(spark):
    """1200 rows, 3 classes, 5 folds, with ties and a little skill."""
    rng = np.random.default_rng(42)
    n = 1200
    label = rng.choice(3, n, p=[0.38, 0.15, 0.47])
    p = rng.dirichlet([2, 1, 2], n)
    p[np.arange(n), label] += 0.4
    p = np.round(p / p.sum(1, keepdims=True), 2)
    p[:, 2] = 1 - p[:, 0] - p[:, 1]
    fold = np.arange(n) % 5
    df = prob_rows(spark, [(i, int(label[i]), int(fold[i]), [float(x) for x in p[i]]) for i in range(n)])
    return df.cache(), label, fold, np.array([r["probs"] for r in df.orderBy("key").collect()])
