"""WARC round trip, and reading by byte ranges of every size."""

import gzip
import hashlib
import os

import pytest

from foldwright.llm import warc

BIG = "<p>" + "page text " * 30 + "</p>"
PAGES = [(5, "http://a.example/x", BIG), (2, "http://b.example/\r\nX: y", BIG), (3, None, None), (4, "u", ""), (6, "u", "short"),
         (7, "u", "short"), (2, "http://b.example/", BIG), (None, "u", BIG), (8, "u", "é漢" * 60), (9, "u", "\r\n\r\n" + BIG),
         (10, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "y" * 100), (13, "u", "y" * 100), (None, "v", "only without ids " * 20),
         (None, "v", "only without ids " * 20)]


def expected(pages):
    first = {}
    for k, _, h in pages:
        if h is not None and len(h.encode()) >= 100 and k is not None:
            first[h] = min(k, first.get(h, k))
    out = []
    for k, _, h in pages:
        data = (h or "").encode()
        to = first.get(h)
        revisit = to is not None and to != k
        out.append((k, "revisit" if revisit else "response", to if revisit else None, len(data), hashlib.sha256(data).hexdigest()))
    return sorted(out, key=repr)


def found(spark, path):
    rows = warc.page_records(warc.read_archives(spark, path)).collect()
    return rows, sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in rows), key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    extra = [(*p, "c", "d", 1) for p in PAGES]
    return spark.createDataFrame(extra, "page_id bigint, url string, html string, digest string, first string, size int").repartition(3)


def test_round_trip(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    rows, got = found(spark, path)
    assert got == expected(PAGES)
    texts = {k: h for k, _, h in PAGES if k is not None}
    for r in rows:
        if r["record_type"] == "response" and r["page_id"] is not None:
            assert bytes(r["payload"]).decode() == (texts[r["page_id"]] or "")
    for name in os.listdir(path):
        if name.startswith("part"):
            raw = open(f"{path}/{name}", "rb").read()
            assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == raw.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00")


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert found(spark, path)[1] == []


@pytest.mark.parametrize("size", [64, 300, 1000, 4096, 100_000])
def test_ranges(spark, tmp_path, size):
    """Members with the magic inside (stored, not compressed) and damaged ones, at every kind of range border."""
    records, raw = [], b""
    for k in range(60):
        payload = (b"\x1f\x8b\x08" * (k % 7) + bytes([k]) * 37 + b"\x1f\x8b\x08\x00WARC/") * (1 + k % 5)
        record = (f"WARC/1.0\r\nWARC-Type: resource\r\nN: {k}\r\nContent-Length: {len(payload)}\r\n\r\n").encode() + payload + b"\r\n\r\n"
        records.append((str(k), payload))
        member = warc._gzip(record, 0 if k % 2 else 6)
        raw += member
        if k % 10 == 3:
            raw += b"\x1f\x8b\x08\x00 not a member "
    os.makedirs(tmp_path / "w")
    (tmp_path / "w" / "some.warc").write_bytes(raw)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = warc.read_archives(spark, str(tmp_path / "w"))
        assert rows.rdd.getNumPartitions() > (len(raw) // size) // 2
        got = sorted((r["headers"]["N"], bytes(r["block"])) for r in rows.collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == sorted(records)


@pytest.mark.parametrize("size", [64, 300, 100_000])
def test_magic_before_the_first_text(spark, tmp_path, size):
    """The magic stands where the member has not given any text: in a name in its gzip header; false beginnings before members."""
    records, raw = [], b""
    for k in range(40):
        payload = bytes([65 + k % 26]) * (20 + 7 * k)
        member = warc._gzip(f"WARC/1.0\r\nN: {k}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n")
        assert member[3] == 0
        name = (b"a" * (k % 30) + b"\x1f\x8b\x08") * (1 + k % 3) + b"\0"
        raw += member[:3] + b"\x08" + member[4:10] + name + member[10:]
        raw += b"\x1f\x8b\x08\x08\x01\x01" * (k % 4 == 1)  # a header that swallows the next one's magic
        records.append((str(k), payload))
    os.makedirs(tmp_path / "w")
    (tmp_path / "w" / "some.warc").write_bytes(raw)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sorted((r["headers"]["N"], bytes(r["block"])) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == sorted(records)


def test_long_members_end_with_zero():
    record = b"WARC/1.1\r\n\r\n" + b"z" * ((1 << 24) + 5)
    member = warc._member(record, 1)
    assert member[-1] == 0 and gzip.decompress(member) == record


def archive(n, payload=lambda k: bytes([65 + k % 26]) * (20 + 97 * k)):
    out = []
    for k in range(n):
        block = payload(k)
        out.append((str(k), block, f"WARC/1.0\r\nWARC-Type: resource\r\nN: {k}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"))
    return out


@pytest.mark.parametrize("size", [50, 1000, 10_000_000])
def test_archives_named_gz_and_plain_ones(spark, tmp_path, size):
    """Both names, and a third one, give all records; a plain payload may hold version lines."""
    records = archive(40, lambda k: b"text\r\n\r\nWARC/1.0 is a format\r\n" * (k % 3) + bytes([65 + k % 26]) * (20 + 97 * k))
    (tmp_path / "w" / "sub").mkdir(parents=True)
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for _, _, r in records))
    (tmp_path / "w" / "sub" / "b.warc").write_bytes(b"".join(r for _, _, r in records))
    (tmp_path / "w" / "c.dat").write_bytes(b"".join(gzip.compress(r) for _, _, r in records))
    (tmp_path / "w" / "empty.warc.gz").write_bytes(b"")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = warc.read_archives(spark, str(tmp_path / "w")).collect()
        assert warc.damaged_members(spark, str(tmp_path / "w")).collect() == []
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = sorted((k, b) for k, b, _ in records)
    for name in ("a.warc.gz", "b.warc", "c.dat"):
        assert sorted((r["headers"]["N"], bytes(r["block"])) for r in rows if r["file"].endswith(name)) == want


def test_damaged_members_are_listed(spark, tmp_path):
    records = archive(12)
    members = [bytearray(gzip.compress(r)) for _, _, r in records]
    members[5][20:60] = bytes(40)
    starts = [sum(map(len, members[:k])) for k in range(12)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(bytes, members))[:-30])
    plain = [r for _, _, r in records]
    plain[7] = plain[7].replace(b"Content-Length: ", b"Content-Length: 9")
    (tmp_path / "b.warc").write_bytes(b"".join(plain))
    got = {}
    for r in warc.read_archives(spark, str(tmp_path)).collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], set()).add(int(r["headers"]["N"]))
    assert got == {"a.warc.gz": set(range(11)) - {5}, "b.warc": set(range(12)) - {7}}
    lost = {(r["file"].rsplit("/", 1)[1], r["start"]) for r in warc.damaged_members(spark, str(tmp_path)).collect()}
    assert lost == {("a.warc.gz", starts[5]), ("a.warc.gz", starts[11]), ("b.warc", sum(map(len, plain[:7])))}


@pytest.mark.parametrize("name,data", [("a.warc.gz", b"no archive at all"), ("a.warc", b"<html>" * 99), ("a.gz", gzip.compress(b"some text")),
                                       ("b.warc.gz", gzip.compress(b"WARC/1.0\r\n\r\n")[:-9])])
def test_files_without_records_are_an_error(spark, tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    with pytest.raises(Exception, match="does not begin with a WARC record"):
        warc.read_archives(spark, str(tmp_path)).count()
