"""Shared helpers of the operators: written tables and caches that live as long as a Python worker."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder on the storage that the cluster shares (spark.checkpoint.dir)."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage as checkpoint() does, but later reads take only the columns they need.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that an operator's own columns beside it cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def text_slices(batch: pa.RecordBatch, column: str | int, most_chars: int = 500_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive rows of a batch with their texts ("" for null), at most most_chars bytes together or one row.

    Only one slice at a time is turned into Python strings, so memory follows most_chars, not the batch.
    """
    size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)))
    begin = 0
    while begin < batch.num_rows:
        before = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, before + most_chars, side="right")))
        part = batch.slice(begin, end - begin)
        yield part, [t or "" for t in part.column(column).to_pylist()]
        begin = end


def worker_cache(kind: str, key: str, make):
    """make() once per Python worker process and key; a worker keeps one object of each kind, the last one used."""
    kept = sys.modules.setdefault("_foldwright_worker", types.ModuleType("_foldwright_worker")).__dict__
    if kept.get(kind, (None,))[0] != key:
        kept.pop(kind, None)  # free the old one first
        kept[kind] = (key, make())
    return kept[kind][1]
