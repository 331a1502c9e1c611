"""Session helpers: a tuned local session and lineage cuts on shared storage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "foldwright", cores: str | int | None = None) -> SparkSession:
    """A session for tests and benchmarks. On a cluster the caller brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where none is named: a relative path, which Hadoop resolves to the user's home on the default (shared) file system;
    with a local master, where one machine does everything, that machine's scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    one_machine = sc.master.split("[")[0] == "local"
    scratch = f"file:{spark.conf.get('spark.local.dir', '/tmp')}/foldwright-checkpoints"
    sc.setCheckpointDir(named or (scratch if one_machine else "foldwright-checkpoints"))
    return sc.getCheckpointDir()


def freeze(df: DataFrame) -> DataFrame:
    """Materialise df on the checkpoint folder so that a lost executor cannot change it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
