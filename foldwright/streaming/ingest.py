"""Resumable encoding of a growing image folder with Structured Streaming.

Spark's checkpoint remembers which files are done: a rerun after a crash takes up only the
rest, and a rerun without new files does nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.sources import images
from foldwright.sources.tables import is_complete, write_versioned

_BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
_IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def image_stream(spark: SparkSession, root: str, files_per_batch: int = 4000) -> DataFrame:
    """path, content of the image files under root, decoded by the JVM (JPEG, PNG, BMP); use with `decode_pixels`."""
    return images.packed_pixels(spark.readStream.format("image").schema(_IMAGE).options(**images.image_options())
                                .option("maxFilesPerTrigger", files_per_batch).load(root))


def content_stream(spark: SparkSession, root: str, files_per_batch: int = 4000) -> DataFrame:
    """path, content of the image files as they are, for a decoder of one's own."""
    return (spark.readStream.format("binaryFile").schema(_BINARY_FILE).option("recursiveFileLookup", "true")
            .option("pathGlobFilter", images.image_glob()).option("maxFilesPerTrigger", files_per_batch).load(root))


def encode_resumable(spark: SparkSession, root: str, out: str, checkpoint: str, encoder: Callable[[], Callable],
                     views: Sequence[Callable] = (), decoder: images.Decoder = images.decode_pixels,
                     files_per_batch: int = 4000) -> DataFrame:
    """Encode all files not yet done, then return every vector written so far (path, vec).

    JPEG, PNG and BMP need no decoder; one of one's own gets the file's bytes.
    """
    stream = image_stream if decoder is images.decode_pixels else content_stream
    rows = images.encode(stream(spark, root, files_per_batch), encoder, views, decoder)
    query = (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(out)


def extract_all(spark: SparkSession, jobs: Mapping[str, tuple[str, Callable[[], Callable], Sequence[Callable]]],
                base: str, decoder: images.Decoder = images.decode_pixels) -> dict[str, str]:
    """Encode several (folder, encoder, views) variants; finished ones are skipped. Returns their paths."""
    paths = {}
    for name, (root, encoder, views) in jobs.items():
        final = f"{base}/{name}"
        paths[name] = final
        if is_complete(spark, final):
            continue
        rows = encode_resumable(spark, root, f"{base}/_parts/{name}", f"{base}/_progress/{name}", encoder, views, decoder)
        once = rows.groupBy("path").agg(F.first("vec").alias("vec"))  # a replayed batch may repeat a file
        write_versioned(once, final, {"source": root, "views": len(views)}, allow_overwrite=True)
    return paths
