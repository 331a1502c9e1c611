"""Image corpora: listing, health, sizes, perceptual hashes, batched encoding.

Listings read file metadata only. Decoding runs in Arrow batches inside tasks; a decoder is a
function bytes -> array of height x width x channels (uint8), or None when unreadable. Formats the
JVM knows come decoded from `read_pixels`; others (WebP) need the user's decoder on `read_content`.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.functions.paths import file_name
from foldwright.functions.probs import half_even
from foldwright.operators.splits import seeded_sample
from foldwright.schema import FOLDER_LABELS, IMAGE_SUFFIXES
from foldwright.sources.ranges import tree_digests

Decoder = Callable[[bytes], "np.ndarray | None"]


def image_glob() -> str:
    """A file-name pattern for the image suffixes in either case, applied while folders are listed."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in s) for s in IMAGE_SUFFIXES) + "}"


def _files(spark: SparkSession, root: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", image_glob())
            .load(root))


def folder_label(path: str, label_map: Mapping[str, int]) -> tuple[Column, Column]:
    """(label_name, label) from the folder that holds the file; NULL label for any other folder."""
    name = F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)
    label = F.lit(None).cast("int")
    for folder, i in label_map.items():
        label = F.when(name == folder, i).otherwise(label)
    return name.alias("label_name"), label.alias("label")


def require_classes(labelled: DataFrame, label_map: Mapping[str, int]) -> None:
    """Every class of the map has at least one row."""
    found = {r["label_name"] for r in labelled.select("label_name").distinct().collect()}  # at most K
    missing = [c for c in label_map if c not in found]
    if missing:
        raise FileNotFoundError(f"no images for {missing}")


def scan_labelled(spark: SparkSession, root: str, label_map: Mapping[str, int] = FOLDER_LABELS) -> DataFrame:
    """path, label_name, label from class folders below root; a class without images is an error."""
    out = _files(spark, root).select("path", *folder_label("path", label_map)).where(F.col("label").isNotNull())
    require_classes(out, label_map)
    return out


def scan_unlabelled(spark: SparkSession, root: str) -> DataFrame:
    """path, filename, in path order."""
    return _files(spark, root).select("path", file_name("path").alias("filename")).orderBy("path")


def common_root(df: DataFrame, path: str = "path") -> str:
    """The deepest folder above every path. Only the first and the last path in order decide."""
    folder = F.regexp_replace(path, r"/[^/]*$", "/")
    ends = df.agg(F.min(folder).alias("a"), F.max(folder).alias("b")).first()
    if ends["a"] is None:
        return ""
    shared = os.path.commonprefix([ends["a"], ends["b"]])
    return shared[:shared.rfind("/") + 1].rstrip("/")


def read_content(spark: SparkSession, root: str) -> DataFrame:
    """path, content, length of every image file."""
    return _files(spark, root).select("path", "content", "length")


def read_pixels(spark: SparkSession, root: str) -> DataFrame:
    """path, content with pixels decoded by the JVM (JPEG, PNG, BMP); use with `decode_pixels`.

    content is height, width and channels as 32-bit numbers, then the bytes; NULL when unreadable.
    """
    return packed_pixels(spark.read.format("image").options(**image_options()).load(root))


def image_options() -> dict[str, str]:
    return {"dropInvalid": "false", "recursiveFileLookup": "true", "pathGlobFilter": image_glob()}


def packed_pixels(pictures: DataFrame) -> DataFrame:
    """path, content from rows of Spark's image source, batch or stream."""
    rows = pictures.select("image.*")
    head = F.unhex(F.format_string("%08x%08x%08x", "height", "width", "nChannels"))
    return rows.select(F.col("origin").alias("path"), F.when(F.col("height") > 0, F.concat(head, "data")).alias("content"))


def decode_pixels(content: bytes | None) -> np.ndarray | None:
    """Grey, RGB or RGBA array from the output of `read_pixels`."""
    if content is None:
        return None
    h, w, bands = struct.unpack(">III", content[:12])
    image = np.frombuffer(content, np.uint8, offset=12).reshape(h, w, bands)
    return image if bands < 3 else image[:, :, [2, 1, 0, *range(3, bands)]]  # stored blue first


_INSPECTED = "path string, ok boolean, width int, height int, channels int, phash bigint"


def inspect(images: DataFrame, decoder: Decoder = decode_pixels) -> DataFrame:
    """path, ok, width, height, channels, phash from one full decode of every file.

    `images` needs path and content: of `read_pixels`, or of `read_content` with a decoder for its format. An unreadable
    file has ok = false and NULLs.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = []
            for content in b["content"]:
                d = decoder(content)
                seen.append((None,) * 4 if d is None else (d.shape[1], d.shape[0], d.shape[2], phash_bits(d)))
            columns = list(zip(*seen)) or [()] * 4
            yield pd.DataFrame({
                "path": b["path"].to_numpy(), "ok": [s[0] is not None for s in seen],
                **{name: pd.array(list(c), dtype=kind) for name, c, kind in zip(
                    ("width", "height", "channels", "phash"), columns, ("Int32", "Int32", "Int32", "Int64"))}})

    return images.select("path", "content").mapInPandas(run, _INSPECTED)


def image_health(images: DataFrame, decoder: Decoder = decode_pixels) -> DataFrame:
    """path, ok, width, height, channels. Split it with `healthy` and `skip_list`."""
    return inspect(images, decoder).drop("phash")


def healthy(health: DataFrame) -> DataFrame:
    return health.where("ok")


def skip_list(health: DataFrame) -> DataFrame:
    return health.where(~F.col("ok")).select("path")


def image_stats(health: DataFrame, sample_n: int | None = None, seed: int = 42) -> DataFrame:
    """path, width, height, channels, aspect_ratio of readable images, optionally of a seeded sample."""
    rows = health if sample_n is None else seeded_sample(health, sample_n, seed, "path")
    return rows.where("ok").select(
        "path", "width", "height", "channels", half_even(F.col("width") / F.col("height"), 3).alias("aspect_ratio"))


# Weights of the grey value in 1/65536, taps of the windowed sinc, fraction bits of a filter's weights.
_GREY = (19595, 38470, 7471)
_TAPS, _FRACTION = 3, 22


def _grey(image: np.ndarray) -> np.ndarray:
    """Grey values of 8 bits; alpha is ignored."""
    if image.shape[2] < 3:
        return image[:, :, 0].astype(np.int64)
    return (image[:, :, :3].astype(np.int64) @ np.array(_GREY) + (1 << 15)) >> 16


def _sinc_weights(size: int, target: int) -> np.ndarray:
    """target x size matrix of a sinc windowed by a wider sinc, stretched when shrinking; rows sum to 1, in fixed-point numbers."""
    scale = size / target
    stretch = max(scale, 1.0)
    centre = (np.arange(target)[:, None] + 0.5) * scale
    reach = _TAPS * stretch
    low = np.maximum((centre - reach + 0.5).astype(np.int64), 0)
    high = np.minimum((centre + reach + 0.5).astype(np.int64), size)
    cells = np.arange(size)[None, :]
    x = (cells - centre + 0.5) / stretch
    weight = np.where((cells >= low) & (cells < high) & (np.abs(x) <= _TAPS), np.sinc(x) * np.sinc(x / _TAPS), 0.0)
    weight /= weight.sum(axis=1, keepdims=True)
    return np.trunc(weight * (1 << _FRACTION) + np.where(weight < 0, -0.5, 0.5)).astype(np.int64)


def shrink(grey: np.ndarray, size: int) -> np.ndarray:
    """size x size 8-bit picture: rows are resampled along their length, then columns, each result rounded to 8 bits."""
    def along(pixels: np.ndarray) -> np.ndarray:
        if pixels.shape[1] == size:
            return pixels
        sums = pixels @ _sinc_weights(pixels.shape[1], size).T
        return np.clip((sums + (1 << (_FRACTION - 1))) >> _FRACTION, 0, 255)

    return along(along(grey).T).T


def _cosine_basis(n: int, keep: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(keep)[:, None] / (2 * n))


def phash_bits(image: np.ndarray, size: int = 32, keep: int = 8) -> int:
    """64-bit perceptual hash: low cosine frequencies of the shrunken grey image above their median.

    Grey values, filter and rounding are those of common imaging libraries, so stored hashes of the usual kind (8 x 8 of 32 x 32,
    first frequency first, highest bit first) can be compared with these.
    """
    small = shrink(_grey(image), size).astype(np.float64)
    basis = _cosine_basis(size, keep)
    low = np.round(basis @ small @ basis.T, 9)
    word = 0
    for bit in (low > np.median(low)).ravel():
        word = (word << 1) | int(bit)
    return word - (1 << 64) if word >= 1 << 63 else word


def phash64(images: DataFrame, decoder: Decoder = decode_pixels) -> DataFrame:
    """path, phash: signed 64-bit hash, NULL for an unreadable image."""
    return inspect(images, decoder).select("path", "phash")


def encode(images: DataFrame, encoder: Callable[[], Callable], views: Sequence[Callable] = (),
           decoder: Decoder = decode_pixels, batch: int = 64) -> DataFrame:
    """path, vec: encoder output per image, averaged over the plain image and its views.

    `encoder` is a factory called once per task; it returns a function from a list of images to
    an n x D matrix. A view maps an image to a changed image. Unreadable images and non-finite
    vectors are errors.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for whole in batches:
            for lo in range(0, len(whole), batch):
                b = whole.iloc[lo:lo + batch]
                pictures = [decoder(c) for c in b["content"]]
                broken = [p for p, d in zip(b["path"], pictures) if d is None]
                if broken:
                    raise ValueError(f"unreadable images: {broken[:3]}")
                total = np.asarray(model(pictures), dtype=np.float64)
                for view in views:
                    total = total + np.asarray(model([view(p) for p in pictures]), dtype=np.float64)
                vecs = (total / (1 + len(views))).astype(np.float32)
                if vecs.ndim != 2 or len(vecs) != len(b) or not np.isfinite(vecs).all():
                    raise ValueError("the encoder must return one finite vector per image")
                yield pd.DataFrame({"path": b["path"].to_numpy(), "vec": list(vecs)})

    return images.select("path", "content").mapInPandas(run, "path string, vec array<float>")


def file_digest(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, digest: 16 hex digits for each file, whatever its size (see ranges.tree_digests)."""
    return tree_digests(spark, paths)
