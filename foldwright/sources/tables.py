"""Table files: typed CSV reads, versioned writes, manifests, ordered submissions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright import schema as S
from foldwright.functions.paths import file_name
from foldwright.operators.ordering import rank_rows
from foldwright.operators.validate import assert_ok, validate_shards, validate_vectors

_META, _VERSIONS, _CURRENT = "_meta", "_versions", "_current"


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a checked header and a given schema; a malformed row is an error."""
    return (spark.read.schema(schema).option("header", "true").option("enforceSchema", "false")
            .option("mode", "FAILFAST").csv(path))


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """key, label, fold"""
    return read_csv(spark, path, S.FOLDS).withColumnRenamed("filepath", "key")


def read_review(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, S.REVIEW)
    back = {v: k for k, v in S.REVIEW_EXPORT.items()}
    return rows.select(*[F.col(c).alias(back.get(c, c)) for c in rows.columns])


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """pos, id, predicted: the template with its line order made explicit, from 0."""
    rows = read_csv(spark, path, S.TEMPLATE).select(
        "id", "predicted", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    rows = rank_rows(rows, [F.asc("_file"), F.asc("_block"), F.asc("_line")], name="pos")
    return rows.select("pos", "id", "predicted")


def export_csv(df: DataFrame, path: str, names: Mapping[str, str], order: Sequence = ()) -> None:
    """Write the columns in contract order under their contract names; absent ones are skipped."""
    rows = df.orderBy(*order) if order else df
    rows.select(*[F.col(c).alias(n) for c, n in names.items() if c in df.columns]).write.option(
        "header", "true").csv(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def _pointer(spark: SparkSession, path: str) -> str | None:
    """Name of the newest pointer of a versioned table."""
    fs, p = _fs(spark, f"{path}/{_CURRENT}")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return max((n for n in names if not n.startswith((".", "_"))), default=None)


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the current version, None without one."""
    name = _pointer(spark, path)
    return f"{path}/{_VERSIONS}/{name.split('-', 1)[1]}" if name else None


def data_path(spark: SparkSession, path: str) -> str:
    """Where a table's data lie: the current version of a versioned one, else the folder itself."""
    return current_version(spark, path) or path


def write_versioned(df: DataFrame, path: str, meta: Mapping | None = None, allow_overwrite: bool = False,
                    partition_by: Sequence[str] = ()) -> dict:
    """Parquet and a manifest in a folder of their own, then a pointer to it; refuses to replace an earlier version.

    The pointer is an empty file whose name says it all, so making it is one atomic step on any file system. Readers follow the
    newest pointer: until that step they get the old version, after it the new one, wherever a writer is killed. Earlier
    versions stay until drop_versions(). The row count comes from the write itself.
    """
    spark = df.sparkSession
    last = _pointer(spark, path)
    if (last or exists(spark, path)) and not allow_overwrite:
        raise FileExistsError(f"{path} exists; choose another name or set allow_overwrite")
    seen = Observation()
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if "vec" in df.columns:
        aggs.append(F.max(F.size("vec")).alias("dim"))
    version = uuid.uuid4().hex
    folder = f"{path}/{_VERSIONS}/{version}"
    df.observe(seen, *aggs).write.partitionBy(*partition_by).parquet(folder)
    full = {**(meta or {}), **seen.get}
    write_json(spark, full, f"{folder}/{_META}")
    number = int(last.split("-", 1)[0]) + 1 if last else 0
    fs, pointer = _fs(spark, f"{path}/{_CURRENT}/{number:010d}-{version}")
    fs.create(pointer, False).close()
    return full


def drop_versions(spark: SparkSession, path: str) -> None:
    """Remove all versions but the current one, also unfinished ones; not while another writer is at work."""
    keep = _pointer(spark, path)
    if keep is None:
        return
    for folder, name in ((_CURRENT, keep), (_VERSIONS, keep.split("-", 1)[1])):
        fs, p = _fs(spark, f"{path}/{folder}")
        for f in fs.listStatus(p):
            if f.getPath().getName() != name:
                fs.delete(f.getPath(), True)


def write_json(spark: SparkSession, record: Mapping, path: str, allow_overwrite: bool = False) -> None:
    """One JSON record as a small text file."""
    line = spark.range(1).select(F.lit(json.dumps(record, sort_keys=True, default=str)).alias("value"))
    line.coalesce(1).write.mode("overwrite" if allow_overwrite else "errorifexists").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def write_summary(row: DataFrame, path: str, allow_overwrite: bool = False) -> None:
    """A one-row table as JSON."""
    row.coalesce(1).write.mode("overwrite" if allow_overwrite else "errorifexists").json(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """There is a current version, its data and manifest were written to the end, and the row counts agree."""
    folder = current_version(spark, path)
    if folder is None or not (exists(spark, f"{folder}/_SUCCESS") and exists(spark, f"{folder}/{_META}/_SUCCESS")):
        return False
    return spark.read.parquet(folder).count() == read_json(spark, f"{folder}/{_META}").get("n_rows")


def read_versioned(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Data and manifest of the current version."""
    folder = current_version(spark, path)
    if folder is None:
        raise FileNotFoundError(f"{path} has no version")
    return spark.read.parquet(folder), read_json(spark, f"{folder}/{_META}")


def write_once(df: DataFrame, path: str, meta: Mapping | None = None) -> DataFrame:
    """Write unless a complete version is there; read it back either way."""
    spark = df.sparkSession
    if not is_complete(spark, path):
        write_versioned(df, path, meta, allow_overwrite=True)
    return read_versioned(spark, path)[0]


def submission(pred: DataFrame, template: DataFrame) -> DataFrame:
    """(pos, id, predicted) for every template row; predicted is NULL where none was given."""
    return template.select("pos", "id").join(pred.select("id", F.col("predicted").cast("int").alias("predicted")),
                                             "id", "left").select("pos", "id", "predicted")


def write_submission(sub: DataFrame, path: str, single_file: bool = False) -> None:
    """id,predicted in template order.

    The parts are range-sorted by pos, so concatenating them in name order gives the whole file at any size.
    single_file=True writes one part for an upload, by a single task.
    """
    rows = sub.repartition(1).sortWithinPartitions("pos") if single_file else sub.orderBy("pos")
    rows.select("id", "predicted").write.option("header", "true").csv(path)


def resolve_files(template: DataFrame, listing: DataFrame, suffixes: Sequence[str] = ("", ".jpg", ".jpeg", ".png"),
                  id_col: str = "id") -> DataFrame:
    """pos, id, path: the first listed file among id, id.jpg, id.jpeg, id.png; NULL path when none.

    `listing` has path. Each file states the ids it can serve and how well, so the template is
    joined once. Missing ids keep their row, so later rows do not move up.
    """
    name = file_name("path")
    serves = F.array(*[
        F.when(name.endswith(s), F.struct(name.substr(F.lit(1), F.length(name) - len(s)).alias("id"),
                                          F.lit(i).alias("rank")))
        for i, s in enumerate(suffixes)])
    offers = listing.select("path", F.explode(serves).alias("s")).where(F.col("s").isNotNull())
    best = offers.groupBy("s.id").agg(F.min_by("path", F.struct("s.rank", "path")).alias("path"))
    ids = template.select("pos", F.col(id_col).cast("string").alias("id"))
    return ids.join(best, "id", "left").select("pos", "id", "path")


def merge_shards(spark: SparkSession, shards: DataFrame, paths: Sequence[str], n_expected: int, out: str,
                 meta: Mapping | None = None) -> dict:
    """Check the shard table, then write all shards as one version; nothing is written on a gap.

    Rows carry their key, so the order of the shard files does not matter.
    """
    assert_ok(validate_shards(shards, n_expected))
    rows = spark.read.parquet(*[data_path(spark, p) for p in paths])
    assert_ok(validate_vectors(rows, n_expected))
    return write_versioned(rows, out, meta)


def required_fields(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """Report rows for the presence of a JSON artefact and each of its fields."""
    have = read_json(spark, path) if exists(spark, path) else {}
    rows = [("present", bool(have), 0 if have else 1)]
    rows += [(f"field_{f}", f in have, 0 if f in have else 1) for f in fields]
    return spark.createDataFrame(rows, "check string, ok boolean, n_bad bigint")


def artefacts_present(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Report rows: every named artefact exists and is not empty."""
    rows = []
    for name, path in paths.items():
        fs, p = _fs(spark, path)
        ok = fs.exists(p) and fs.getContentSummary(p).getLength() > 0
        rows.append((name, ok, 0 if ok else 1))
    return spark.createDataFrame(rows, "check string, ok boolean, n_bad bigint")
