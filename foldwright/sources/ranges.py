"""Files read in byte ranges: digests of files of any size, and .npy matrices.

Both are Python data sources. The driver asks the file system for sizes and reads headers; a partition is a byte range that its task
opens on the same file system (local, HDFS or an object store, whatever the URI names), so nothing has to be mounted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DIGEST_RANGE = 64 << 20
_READ = 1 << 20


def files_under(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files that a path, pattern or folder names, in name order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found, todo = [], list(fs.globStatus(p) or [])
    if not todo:
        raise FileNotFoundError(path)
    while todo:
        f = todo.pop()
        if f.isDirectory():
            todo += [c for c in fs.listStatus(f.getPath()) if not c.getPath().getName().startswith(("_", "."))]
        else:
            found.append((f.getPath().toString(), f.getLen()))
    return sorted(found)


def opened(uri: str):
    """A seekable file of any file system that URIs can name; Hadoop's file:/x means file:///x."""
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:"):]
    fs, path = arrow_fs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


@dataclass
class ByteRange(InputPartition):
    uri: str
    start: int
    length: int
    first_row: int = 0


class _RangeDigests(DataSource):
    """(path, start, digest): SHA-256 of every range of the files."""

    @classmethod
    def name(cls) -> str:
        return "byte_range_digests"

    def schema(self) -> str:
        return "path string, start bigint, digest binary"

    def reader(self, schema) -> DataSourceReader:
        return _RangeDigestReader(self.options)


class _RangeDigestReader(DataSourceReader):
    def __init__(self, options):
        n, size = int(options["files"]), int(options["range"])
        self.parts = [ByteRange(options[f"path{i}"], at, min(size, int(options[f"bytes{i}"]) - at))
                      for i in range(n) for at in range(0, max(int(options[f"bytes{i}"]), 1), size)]

    def partitions(self) -> Sequence[InputPartition]:
        return self.parts

    def read(self, part: ByteRange) -> Iterator[tuple]:
        h, left = hashlib.sha256(), part.length
        with opened(part.uri) as f:
            f.seek(part.start)
            while left:
                data = f.read(min(_READ, left))
                if not data:
                    raise EOFError(f"{part.uri} became shorter")
                h.update(data)
                left -= len(data)
        yield part.uri, part.start, h.digest()


def tree_digests(spark: SparkSession, paths: Sequence[str], range_bytes: int = DIGEST_RANGE) -> DataFrame:
    """path, digest (16 hex digits): of files of one range their SHA-256, of longer ones the SHA-256 of their ranges' digests in order.

    Ranges are digested by tasks of their own, so one file of any size takes many tasks and a megabyte of memory each.
    """
    files = sorted({f for p in paths for f in files_under(spark, p)})
    spark.dataSource.register(_RangeDigests)
    options = {"files": len(files), "range": range_bytes}
    for i, (uri, size) in enumerate(files):
        options |= {f"path{i}": uri, f"bytes{i}": size}
    rows = spark.read.format("byte_range_digests").options(**options).load()
    joined = F.array_sort(F.collect_list(F.struct("start", "digest")))
    whole = rows.groupBy("path").agg(joined.alias("d")).withColumn("d", F.transform("d", lambda x: x["digest"]))
    top = F.when(F.size("d") == 1, F.lower(F.hex(F.get("d", F.lit(0))))).otherwise(F.sha2(F.aggregate("d", F.lit(b""), lambda a, x: F.concat(a, x)), 256))
    return whole.select("path", F.substring(top, 1, 16).alias("digest"))


class _Npy(DataSource):
    """Rows of a two-dimensional .npy matrix in byte ranges."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return f"row bigint, `{self.options.get('name', 'vec')}` array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


class _NpyReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.column, self.rows_per_task = options["path"], options.get("name", "vec"), int(options.get("rowspertask", 65536))
        with opened(self.uri) as f:
            version = np.lib.format.read_magic(f)
            header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            self.shape, fortran, self.dtype = header(f)
            self.offset = f.tell()
        if len(self.shape) != 2:
            raise ValueError(f"expected a matrix, found shape {self.shape}")
        if fortran or self.dtype.hasobject:
            raise ValueError("expected numbers stored row by row")

    def partitions(self) -> Sequence[InputPartition]:
        n, width = self.shape[0], self.shape[1] * self.dtype.itemsize
        return [ByteRange(self.uri, self.offset + at * width, min(self.rows_per_task, n - at) * width, at) for at in range(0, n, self.rows_per_task)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        width = self.shape[1] * self.dtype.itemsize
        rows, at = (part.length // width if width else 0), part.first_row
        step = max(1, 8 * _READ // max(width, 1))
        with opened(part.uri) as f:
            f.seek(part.start)
            for lo in range(0, rows, step):
                n = min(step, rows - lo)
                data = f.read(n * width)
                if len(data) != n * width:
                    raise EOFError(f"{part.uri} is shorter than its header says")
                m = np.frombuffer(data, dtype=self.dtype).astype(np.float32)
                if not np.isfinite(m).all():
                    raise ValueError(f"non-finite values in rows {at + lo}..{at + lo + n - 1}")
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * self.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at + lo, at + lo + n)), pa.ListArray.from_arrays(offsets, pa.array(m))], ["row", self.column])


def read_npy(spark: SparkSession, path: str, name: str = "vec", rows_per_task: int = 65536) -> DataFrame:
    """row, <name>: a two-dimensional .npy matrix of any file system, read in row ranges.

    `row` is the position the matrix was written in: join it to the table that lists the keys in that order. Non-finite values
    are an error.
    """
    (uri, _), = files_under(spark, path)
    spark.dataSource.register(_Npy)
    rows = spark.read.format("npy").options(name=name, rowspertask=rows_per_task).load(uri)
    if rows_per_task < 1:
        raise ValueError("rows_per_task must be positive")
    _NpyReader({"path": uri})  # a bad header is an error here, not in the first job
    return rows
