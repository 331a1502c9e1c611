import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright import schema as S
from foldwright.sources import tables, vectors


def put(path, text):
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_folds_csv(spark, tmp_path):
    path = put(tmp_path / "folds.csv", "filepath,label,fold\n/a.jpg,0,1\n/b.jpg,2,4\n")
    assert sorted(map(tuple, tables.read_folds(spark, path).collect())) == [("/a.jpg", 0, 1), ("/b.jpg", 2, 4)]
    with pytest.raises(Exception):
        tables.read_folds(spark, put(tmp_path / "h.csv", "path,label,fold\n/a.jpg,0,1\n")).collect()
    with pytest.raises(Exception):
        tables.read_folds(spark, put(tmp_path / "v.csv", "filepath,label,fold\n/a.jpg,zero,1\n")).collect()


def test_template_keeps_line_order(spark, tmp_path):
    ids = [f"img{(i * 7919) % 1000:04d}" for i in range(1000)]
    path = put(tmp_path / "t.csv", "id,predicted\n" + "".join(f"{i},0\n" for i in ids))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # many splits
    try:
        rows = tables.read_template(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["id"] for r in sorted(rows, key=lambda r: r["pos"])] == ids
    assert sorted(r["pos"] for r in rows) == list(range(1000))


def test_versioned_write(spark, tmp_path):
    path = str(tmp_path / "v")
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "key string, vec array<float>")
    assert not tables.is_complete(spark, path)
    meta = tables.write_versioned(df, path, {"checkpoint": "c", "seed": 42})
    assert meta == {"checkpoint": "c", "seed": 42, "n_rows": 2, "dim": 2}
    assert tables.is_complete(spark, path) and tables.read_versioned(spark, path)[1] == meta
    with pytest.raises(FileExistsError):
        tables.write_versioned(df, path)
    assert tables.write_versioned(df.limit(1), path, allow_overwrite=True)["n_rows"] == 1
    assert tables.write_once(df, path).count() == 1  # complete: kept
    assert vectors.read_vectors(spark, path).count() == 1


def test_incomplete_versions(spark, tmp_path):
    path = str(tmp_path / "v")
    df = spark.range(3).withColumnRenamed("id", "key")
    df.write.parquet(path)
    assert not tables.is_complete(spark, path)  # no version
    with pytest.raises(FileExistsError):
        tables.write_versioned(df, path)
    assert tables.write_once(df, path).count() == 3 and tables.is_complete(spark, path)
    tables.remove(spark, tables.current_version(spark, path) + "/_meta")
    assert not tables.is_complete(spark, path)  # no manifest
    tables.write_json(spark, {"n_rows": 4}, tables.current_version(spark, path) + "/_meta")
    assert not tables.is_complete(spark, path)  # counts differ
    assert tables.write_once(df, path).count() == 3 and tables.is_complete(spark, path)


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["data", "manifest", "pointer"])
def test_a_writer_killed_anywhere_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    tables.write_versioned(spark.range(5), path, {"v": 1})
    new = spark.range(9)
    if step == "data":
        new = new.selectExpr("IF(id = 7, raise_error('killed'), id) AS id")
    elif step == "manifest":
        monkeypatch.setattr(tables, "write_json", lambda *a, **k: (_ for _ in ()).throw(Killed("killed")))
    else:
        one = tables._fs
        monkeypatch.setattr(tables, "_fs", lambda s, p: (_ for _ in ()).throw(Killed("killed")) if "/_current/" in p else one(s, p))
    with pytest.raises(Exception, match="killed"):
        tables.write_versioned(new, path, {"v": 2}, allow_overwrite=True)
    monkeypatch.undo()
    rows, meta = tables.read_versioned(spark, path)
    assert rows.count() == 5 and meta["v"] == 1 and tables.is_complete(spark, path)
    held = tables.read_versioned(spark, path)[0]  # a reader from before goes on while a new version comes
    tables.write_versioned(spark.range(9), path, {"v": 3}, allow_overwrite=True)
    assert tables.read_versioned(spark, path)[0].count() == 9 and held.count() == 5
    tables.drop_versions(spark, path)
    assert len([d for d in os.listdir(tmp_path / "t" / "_versions") if not d.startswith(".")]) == 1
    assert tables.is_complete(spark, path) and tables.read_versioned(spark, path)[1]["v"] == 3


def test_a_version_can_be_made_from_the_one_before(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_versioned(spark.range(4), path)
    tables.write_versioned(tables.read_versioned(spark, path)[0].where("id > 0"), path, allow_overwrite=True)
    assert tables.read_versioned(spark, path)[0].count() == 3
    with pytest.raises(FileNotFoundError):
        tables.read_versioned(spark, str(tmp_path / "none"))


def test_export_contract(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, 2, 0.5), ("a", 0, 1, 0.25)], "key string, fold int, label int, margin double")
    tables.export_csv(df.coalesce(1), str(tmp_path / "x"), S.ISSUE_EXPORT, [F.asc("key")])
    part = [f for f in os.listdir(tmp_path / "x") if f.endswith(".csv")]
    with open(tmp_path / "x" / part[0]) as f:
        assert f.read() == "filepath,fold,label_asli,margin\na,0,1,0.25\nb,1,2,0.5\n"
    assert list(S.REVIEW_EXPORT.values()) == S.REVIEW.fieldNames() and list(S.FOLDS_EXPORT.values()) == S.FOLDS.fieldNames()


def test_submission_file(spark, tmp_path):
    template = spark.createDataFrame([(i, f"f{9 - i}") for i in range(10)], "pos bigint, id string")
    pred = spark.createDataFrame([(f"f{i}", i % 3) for i in range(10)], "id string, predicted int").repartition(4)
    sub = tables.submission(pred, template)
    for single in (True, False):
        out = tmp_path / f"s{single}"
        tables.write_submission(sub, str(out), single)
        parts = sorted(f for f in os.listdir(out) if f.endswith(".csv"))
        lines = []
        for p in parts:
            with open(out / p) as f:
                lines += f.read().splitlines()[1:]
        assert lines == [f"f{9 - i},{(9 - i) % 3}" for i in range(10)]
        assert not single or len(parts) == 1


def test_resolve_files(spark):
    template = spark.createDataFrame([(0, "a.png"), (1, "b"), (2, "c"), (3, "d"), (4, "b")], "pos bigint, id string")
    listing = spark.createDataFrame([("/t/a.png",), ("/t/b.jpeg",), ("/t/b.jpg",), ("/t/d",), ("/t/d.jpg",)], "path string")
    got = {r["pos"]: r["path"] for r in tables.resolve_files(template, listing).collect()}
    assert got == {0: "/t/a.png", 1: "/t/b.jpg", 2: None, 3: "/t/d", 4: "/t/b.jpg"}


def test_merge_shards(spark, tmp_path):
    paths = []
    for s in (3, 0, 6):
        n = min(3, 8 - s)
        df = spark.createDataFrame([(str(i), [float(i)]) for i in range(s, s + n)], "key string, vec array<float>")
        df.write.parquet(str(tmp_path / f"p{s}"))
        paths.append(str(tmp_path / f"p{s}"))
    shards = spark.createDataFrame([(3, 6, 3), (0, 3, 3), (6, 8, 2)], "start bigint, end bigint, n_rows bigint")
    out = str(tmp_path / "merged")
    with pytest.raises(ValueError):
        tables.merge_shards(spark, shards.where("start <> 3"), [paths[1], paths[2]], 8, out)
    assert not tables.exists(spark, out)  # nothing written on a gap
    assert tables.merge_shards(spark, shards, paths, 8, out)["n_rows"] == 8
    assert {r["key"]: r["vec"][0] for r in tables.read_versioned(spark, out)[0].collect()} == {str(i): float(i) for i in range(8)}


def test_npy(spark, tmp_path):
    m = np.random.default_rng(0).normal(size=(1000, 5)).astype(np.float32)
    np.save(tmp_path / "m.npy", m)
    rows = vectors.read_npy(spark, str(tmp_path / "m.npy"), rows_per_task=128).collect()
    assert np.array_equal(np.array([r["vec"] for r in sorted(rows, key=lambda r: r["row"])], np.float32), m)
    m[7, 1] = np.nan
    np.save(tmp_path / "bad.npy", m)
    with pytest.raises(Exception, match="non-finite"):
        vectors.read_npy(spark, str(tmp_path / "bad.npy")).count()
    np.save(tmp_path / "flat.npy", m[:, 0])
    with pytest.raises(ValueError):
        vectors.read_npy(spark, str(tmp_path / "flat.npy"))
    with pytest.raises(FileNotFoundError):
        vectors.read_npy(spark, str(tmp_path / "none.npy"))
    np.save(tmp_path / "turned.npy", np.asfortranarray(m))
    with pytest.raises(ValueError):
        vectors.read_npy(spark, str(tmp_path / "turned.npy"))


def test_npy_ranges_of_other_numbers(spark, tmp_path):
    """Tasks read their byte ranges by URI; halves, doubles and big-endian numbers become floats."""
    m = np.random.default_rng(1).normal(size=(257, 3))
    for kind in ("<f2", "<f8", ">f4", "<i2"):
        np.save(tmp_path / "k.npy", (m * 9).astype(kind))
        rows = vectors.read_npy(spark, f"file:{tmp_path}/k.npy", "emb", rows_per_task=100)
        assert rows.rdd.getNumPartitions() == 3 and rows.columns == ["row", "emb"]
        got = np.array([r["emb"] for r in sorted(rows.collect(), key=lambda r: r["row"])], np.float32)
        assert np.array_equal(got, (m * 9).astype(kind).astype(np.float32))


def test_digests_of_files_of_any_size(spark, tmp_path):
    """Ranges joined as a tree; a sparse file above 2 GB; folders and patterns; an empty file."""
    import hashlib

    from foldwright.sources.ranges import tree_digests
    data = bytes(range(256)) * 1000
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(data)
    (tmp_path / "d" / "empty").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1]: r["digest"] for r in tree_digests(spark, [str(tmp_path / "d")], 100_000).collect()}
    parts = [hashlib.sha256(data[i:i + 100_000]).digest() for i in range(0, len(data), 100_000)]
    assert got == {"a.bin": hashlib.sha256(b"".join(parts)).hexdigest()[:16], "empty": hashlib.sha256(b"").hexdigest()[:16]}
    assert tree_digests(spark, [str(tmp_path / "d" / "a*")]).first()["digest"] == hashlib.sha256(data).hexdigest()[:16]
    with open(tmp_path / "big", "wb") as f:
        f.truncate(3 << 30)
    zero = hashlib.sha256(bytes(64 << 20)).digest()
    assert tree_digests(spark, [str(tmp_path / "big")]).first()["digest"] == hashlib.sha256(zero * 48).hexdigest()[:16]


def test_bad_vector_and_prob_sets(spark, tmp_path):
    spark.createDataFrame([("a", [1.0, float("nan")])], "key string, vec array<double>").write.parquet(str(tmp_path / "v"))
    with pytest.raises(ValueError):
        vectors.read_vectors(spark, str(tmp_path / "v"))
    spark.createDataFrame([("a", 0, [0.9, 0.3, 0.3])], "key string, label int, probs array<double>").write.parquet(
        str(tmp_path / "p"))
    with pytest.raises(ValueError):
        vectors.read_probs(spark, str(tmp_path / "p"))
    assert vectors.read_probs(spark, str(tmp_path / "p"), check=False).count() == 1


def test_handoff_parts(spark, tmp_path):
    path = str(tmp_path / "meta")
    tables.write_json(spark, {"shape": [2, 3], "seed": 42}, path)
    rows = {r["check"]: r["ok"] for r in tables.required_fields(spark, path, ["shape", "img_size"]).collect()}
    assert rows == {"present": True, "field_shape": True, "field_img_size": False}
    open(tmp_path / "empty", "w").close()
    rows = {r["check"]: r["ok"] for r in tables.artefacts_present(
        spark, {"meta": path, "none": str(tmp_path / "none"), "empty": str(tmp_path / "empty")}).collect()}
    assert rows == {"meta": True, "none": False, "empty": False}
    assert tables.required_fields(spark, str(tmp_path / "none"), ["a"]).where("ok").count() == 0


def test_summary_json(spark, tmp_path):
    row = spark.range(1).select(F.lit(3).alias("n"), F.struct(F.lit(0.5).alias("w")).alias("weights"))
    tables.write_summary(row, str(tmp_path / "s"))
    part = next(f for f in os.listdir(tmp_path / "s") if f.endswith(".json"))
    with open(tmp_path / "s" / part) as f:
        assert json.loads(f.read()) == {"n": 3, "weights": {"w": 0.5}}
