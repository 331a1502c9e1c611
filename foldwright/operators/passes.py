"""Training passes over vectors packed into arrays: one scan updates the models of all folds.

A labelled vector table (key, fold, label, vec) is dealt by key over as many tasks as its size asks for, and each task packs its
rows into arrays that the executors keep (memory, then disk; a lost one is packed again from the table). A pass runs a function
on every task's blocks and adds up what it returns in a tree, so the driver sees one sum. Iterative fits need this per-partition
state; that is what RDDs are for, and the only place where this library uses them.

A model is named by the fold it must not see; None is the model that sees all.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Rows per block at most, and entries of vectors per task (64 MB of doubles) where cores do not ask for smaller tasks.
BLOCK_ROWS, TASK_ENTRIES, LEAST_ENTRIES = 4096, 8_000_000, 400_000
_FLAT = 32
#: Bytes of a state that travel with the tasks; every broadcast takes a chunk of 4 MB of the driver's heap.
_WITH_TASK = 1 << 18

Model = int | None


@dataclass(frozen=True)
class Block:
    """Rows of one task: vectors, labels, folds, and which rows are set aside for checks."""
    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    aside: np.ndarray

    def seen_by(self, model: Model) -> np.ndarray:
        return np.ones(len(self.y), dtype=bool) if model is None else self.fold != model


@dataclass(frozen=True)
class Packed:
    blocks: RDD
    dim: int
    counts: dict[tuple[int, int], int]  # rows by (fold, label), without those set aside

    def class_counts(self, model: Model, k: int) -> np.ndarray:
        n = np.zeros(k)
        for (fold, label), rows in self.counts.items():
            if fold != model:
                n[label] += rows
        return n

    def weights(self, models: Sequence[Model], k: int, balanced: bool) -> np.ndarray:
        """Weight of a row by model and class: 1, or rows / (classes * rows of the class)."""
        n = np.array([self.class_counts(m, k) for m in models])
        return n.sum(axis=1, keepdims=True) / (k * np.maximum(n, 1)) if balanced else np.ones(n.shape)

    def release(self) -> None:
        self.blocks.unpersist()


def folds_of(df: DataFrame) -> list[int]:
    found = df.select(F.col("fold").cast("bigint").alias("fold")).distinct().collect()  # a handful
    return sorted((r["fold"] for r in found), key=lambda f: (f is not None, f))


def _pack(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(begin, BLOCK_ROWS)
                x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if len(x) != b.num_rows * dim:
                    raise ValueError(f"vectors must all have {dim} components")
                parts = [x, *(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "fold")),
                         b.column("aside").to_numpy(zero_copy_only=False).astype(np.int8)]
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()]) for p in parts], ["x", "y", "fold", "aside"])

    return run


def _block(row, dim: int) -> Block:
    return Block(np.frombuffer(row["x"]).reshape(-1, dim), np.frombuffer(row["y"], dtype=np.int64),
                 np.frombuffer(row["fold"], dtype=np.int64), np.frombuffer(row["aside"], dtype=np.int8) > 0)


def pack(df: DataFrame, aside: Column | None = None, tasks: int | None = None) -> Packed:
    """Blocks of df. Rows are dealt and ordered by key, so results do not depend on how df lies. aside: rows for checks only."""
    rows = df.select("key", F.col("label").cast("bigint").alias("label"), F.coalesce(F.col("fold").cast("bigint"), F.lit(-1)).alias("fold")
                     if "fold" in df.columns else F.lit(-1).cast("bigint").alias("fold"),
                     F.col("vec").cast("array<double>").alias("vec"), (F.lit(False) if aside is None else aside).alias("aside"))
    sizes = rows.groupBy("fold", "label").agg(F.count_if(~F.col("aside")).alias("n"), F.count(F.lit(1)).alias("all"),
                                              F.max(F.size("vec")).alias("dim")).collect()  # folds x classes
    if not sizes:
        raise ValueError("no rows to fit")
    dim = max(r["dim"] for r in sizes)
    entries = sum(r["all"] for r in sizes) * (dim + 16)
    cores = 2 * df.sparkSession.sparkContext.defaultParallelism
    tasks = tasks or max(1, -(-entries // TASK_ENTRIES), min(-(-entries // LEAST_ENTRIES), cores))
    dealt = rows.repartition(tasks, "key").sortWithinPartitions("key").drop("key")
    packed = dealt.mapInArrow(_pack(dim), "x binary, y binary, fold binary, aside binary")
    blocks = packed.rdd.map(lambda row: _block(row, dim)).persist(StorageLevel.MEMORY_AND_DISK)
    return Packed(blocks, dim, {(r["fold"], r["label"]): r["n"] for r in sizes})


def _added(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def summed(blocks: RDD, work: Callable[[Block], tuple], state=None) -> tuple:
    """work(block, state) of every block, added up in a tree. state is sent once to every executor, a small one with the tasks."""
    sent = None if len(pickle.dumps(state)) <= _WITH_TASK else blocks.context.broadcast(state)
    small = state if sent is None else None

    def task(part: Iterator[Block]) -> Iterator[tuple]:
        now = small if sent is None else sent.value
        found = [reduce(_added, (work(b, now) for b in part))] if (part := list(part)) else []
        return iter(found)

    parts = blocks.mapPartitions(task)
    # Up to _FLAT sums come to the driver at once; more are added up on the way.
    total = parts.reduce(_added) if blocks.getNumPartitions() <= _FLAT else parts.treeReduce(_added)
    if sent is not None:
        sent.destroy()
    return total


def predicted(df: DataFrame, k: int, probabilities: Callable[[np.ndarray, object, Model], np.ndarray], models: dict[Model, object]) -> DataFrame:
    """df with probs: each row by the model that has not seen its fold (or by the only one, named None)."""
    keep = [c for c in df.columns if c != "probs"]
    sent = df.sparkSession.sparkContext.broadcast(models)
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col("vec").cast("array<double>").alias("_x"),
                     (F.col("fold").cast("bigint") if None not in models else F.lit(0).cast("bigint")).alias("_fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(begin, BLOCK_ROWS)
                x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                fold, p = b.column("_fold").to_numpy(zero_copy_only=False), np.zeros((b.num_rows, k))
                for name, model in sent.value.items():
                    mine = np.ones(len(p), dtype=bool) if name is None else fold == name
                    if mine.any():
                        p[mine] = probabilities(x[mine], model, name)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * k), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists], [*keep, "probs"])

    schema = df.select(*[F.col(f"`{c}`") for c in keep]).schema.add("probs", ArrayType(DoubleType()))
    return rows.mapInArrow(run, schema)
