"""WARC archives: one gzip member per record, written by Spark's committer and read by byte ranges.

Writing: Spark's text writer puts rows out byte for byte and ends each with its line separator. A gzip member ends with its
length's highest byte, which is 0 below 16 MiB (longer members are followed by an empty one), so members are written without
their last byte and the separator is that byte: the file is nothing but members, on any storage, through task commits.

Reading: Spark's text reader cuts byte ranges of a file at a separator, and gives a range whatever starts inside it, read to
its end. With the gzip magic as separator every piece is a candidate member. A task accepts a candidate whose header decodes
to a WARC version line, and appends the following pieces while the member goes on (the magic may occur in compressed bytes, even
before the first byte of text comes out). The later pieces of a candidate that fails are tried as beginnings themselves.
What a range cannot finish is joined with the first pieces of the next ranges of its file.

Spark would hand files named *.gz to its own, unsplittable codec, and uncompressed archives hold no magic. Files named *.gz or *.warc
are therefore read by a data source of byte ranges: a task looks for the first member (or version line) that begins in its range
and decodes, follows the records from there, past the range's end where the last one needs it. A file of either kind that does
not begin with a record is an error, never an empty result; members that break off or do not decode are listed by
damaged_members(). A payload that itself holds WARC members byte for byte may be taken for records where a range begins inside it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from foldwright.llm.common import store
from foldwright.sources.ranges import ByteRange, files_under, opened

MAGIC = b"\x1f\x8b\x08"
LEAST_BYTES = 100
RECORD = "file string, headers map<string,string>, block binary"
_PIECE = "file string, range bigint, nth bigint, headers map<string,string>, block binary"


def _gzip(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _member(record: bytes, level: int) -> bytes:
    member = _gzip(record, level)
    return member if member[-1] == 0 else member + _gzip(b"")


def _clean(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def _record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{digest}>", f"WARC-Date: {date}",
             f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([_member(_record(
                    r["page_id"], r["url"], r["payload"], r["size"], r["digest"], r["refers_to"], date), level)[:-1]
                    for r in rows], pa.binary())], names=["member"])

    return run


def write_archives(pages: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z", level: int = 6) -> None:
    """One record per row of pages (page_id, url, html); the payload is the html in UTF-8, empty for null.

    Of the records with equal payloads of at least LEAST_BYTES bytes that with the smallest page_id is a response and the
    others revisit it; rows that share the smallest page_id are all responses. A null page_id is never the smallest; where
    all are null, all are responses.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("bigint"), "digest": F.sha2("payload", 256)})
    # Repeated payloads only; stored, so that the join below has two plain sides and Spark can split a hot digest.
    first = store(rows.where(F.col("size") >= LEAST_BYTES).groupBy("digest")
                  .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") > 1).drop("n"), "payloads")
    rows = rows.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest",
                       F.when(revisit, F.col("first")).alias("refers_to"))
    members = rows.mapInArrow(_members(date, level), "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (the version under its own name) and block of a decoded record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {"version": version}
    for line in lines:
        name, _, value = line.partition(":")
        headers[name.strip()] = value.strip()
    size = headers.get("Content-Length", "")
    return headers, rest[:int(size)] if size.isdigit() else rest.removesuffix(b"\r\n\r\n")


_VERSION = b"WARC/"


class _Open:
    """A member that is being read. It is known as a record once its version line has come out."""

    def __init__(self, nth: int, raw: bytes):
        self.inflate, self.out, self.raw, self.known = zlib.decompressobj(31), [], [], False
        self.add(nth, raw)

    def add(self, nth: int, raw: bytes) -> None:
        self.out.append(self.inflate.decompress(raw))
        self.raw.append((nth, raw))
        if not self.known:
            head = b"".join(self.out)
            self.known = head.startswith(_VERSION)
            if not self.known and (self.whole or not _VERSION.startswith(head)):
                self.raw.pop()
                raise zlib.error("not a WARC record")

    @property
    def whole(self) -> bool:
        return self.inflate.eof


class _Members:
    """Pieces in order -> whole members, and the pieces before the first member known, which may belong to an earlier one."""

    def __init__(self):
        self.member, self.begun = None, False

    def add(self, nth: int, raw: bytes) -> Iterator[tuple[int, _Open | None, bytes]]:
        """(nth, member, b"") or (nth, None, raw)."""
        waiting = [(nth, raw)]
        while waiting:
            piece = waiting.pop(0)
            failed = None
            try:
                if self.member is None:
                    failed = [piece]
                    self.member = _Open(*piece)
                else:
                    failed = [*self.member.raw, piece]
                    self.member.add(*piece)
            except zlib.error:
                # Damaged, or never a beginning; each of its later pieces may be one.
                known, self.member = self.member is not None and self.member.known, None
                if not known and not self.begun:
                    yield (failed[0][0], None, failed[0][1])
                waiting[:0] = failed[1:]
                continue
            self.begun = self.begun or self.member.known
            if self.member.whole:
                yield (piece[0], self.member, b"")
                self.member = None


def _scan(fragments: bool):
    """Pieces of byte ranges -> records, or (fragments) the raw bytes that a range could not place itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, nth, found = None, _Members(), 0, []

        def leave():
            if fragments and members.member is not None:
                for n, raw in members.member.raw:
                    found.append((*at, n, None, raw))

        for batch in batches:
            found = []
            for raw, file, start in zip(*(c.to_pylist() for c in batch.columns)):
                fresh = (file, start) != at
                if fresh:
                    leave()
                    at, members, nth = (file, start), _Members(), 0
                if fresh and start == 0:  # what stands before the first magic
                    if raw.startswith(_VERSION):
                        raise ValueError(f"{file} is not compressed; name it *.warc")
                    continue
                nth += 1
                for n, member, left in members.add(nth, MAGIC + raw):
                    if member is None and fragments:
                        found.append((*at, n, None, left))
                    elif member is not None and not fragments:
                        found.append((*at, n, *parse(b"".join(member.out))))
            if found:
                yield _rows(found)
        found = []
        leave()
        if found:
            yield _rows(found)

    def _rows(found):
        file, start, nth, headers, block = zip(*found)
        return pa.RecordBatch.from_arrays([
            pa.array(file), pa.array(start, pa.int64()), pa.array(nth, pa.int64()),
            pa.array([None if h is None else list(h.items()) for h in headers], pa.map_(pa.string(), pa.string())),
            pa.array(block, pa.binary())], names=["file", "range", "nth", "headers", "block"])

    return run


def _stitch(pieces: pd.DataFrame) -> pd.DataFrame:
    """The members of one file that cross byte ranges and have the magic in their compressed bytes: very few."""
    out, members = [], _Members()
    for nth, (file, raw) in enumerate(pieces.sort_values(["range", "nth"], kind="stable")[["file", "block"]].itertuples(index=False)):
        out += [(file, *parse(b"".join(member.out))) for _, member, _ in members.add(nth, raw) if member is not None]
    return pd.DataFrame(out, columns=["file", "headers", "block"])


def _by_pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Archives of gzip members under any name that Spark's text reader does not unpack itself."""
    pieces = (spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(paths)
              .select(F.col("value").cast("binary").alias("raw"), "_metadata.file_path", "_metadata.file_block_start"))
    records = pieces.mapInArrow(_scan(False), _PIECE).select("file", "headers", "block")
    crossing = pieces.mapInArrow(_scan(True), _PIECE).groupBy("file").applyInPandas(_stitch, RECORD)
    return records.unionByName(crossing)


class _Ranges(DataSource):
    """Records, or damaged members, of archives in byte ranges."""

    @classmethod
    def name(cls) -> str:
        return "warc_ranges"

    def schema(self) -> str:
        return RECORD + ", start bigint, reason string"

    def reader(self, schema) -> DataSourceReader:
        return _RangesReader(self.options)


class _RangesReader(DataSourceReader):
    def __init__(self, options):
        size, self.damaged = max(1, int(options["range"])), options["damaged"] == "true"
        self.parts = [ByteRange(options[f"path{i}"], at, min(size, int(options[f"bytes{i}"]) - at))
                      for i in range(int(options["files"])) for at in range(0, int(options[f"bytes{i}"]), size)]

    def partitions(self) -> list[ByteRange]:
        return self.parts

    def read(self, part: ByteRange) -> Iterator[tuple]:
        with opened(part.uri) as f:
            head = f.read(len(_VERSION))
            if not head.startswith(MAGIC) and head != _VERSION:
                raise ValueError(f"{part.uri} does not begin with a WARC record")
            records = _plain_records if head == _VERSION else _gzip_records
            for start, record, reason in records(f, part.start, part.start + part.length):
                if start == 0 and record is None:
                    raise ValueError(f"{part.uri} does not begin with a WARC record: {reason}")
                if (record is None) == self.damaged:
                    yield (part.uri, *(parse(record) if record is not None else (None, None)), start, reason)


def _find(f, what: bytes, begin: int, end: int) -> int | None:
    """Place of the first `what` that begins in [begin, end)."""
    f.seek(begin)
    held = b""
    while begin < end:
        data = f.read(1 << 16)
        held += data
        at = held.find(what)
        if at >= 0:
            return begin + at if begin + at < end else None
        if not data:
            return None
        cut = max(0, len(held) - len(what) + 1)
        begin, held = begin + cut, held[cut:]
    return None


def _inflated(f, at: int) -> tuple[bytes | None, int, str | None]:
    """(contents, end, None) of the gzip member at a place, or (None, at, why it is none)."""
    f.seek(at)
    inflate, out, read = zlib.decompressobj(31), [], 0
    while not inflate.eof:
        data = f.read(1 << 16)
        if not data:
            return None, at, "breaks off"
        read += len(data)
        try:
            out.append(inflate.decompress(data))
        except zlib.error as e:
            return None, at, str(e)
        text = b"".join(out[:2])[:len(_VERSION)]
        if text and not _VERSION.startswith(text):
            return None, at, "not a WARC record"
    return b"".join(out), at + read - len(inflate.unused_data), None


def _gzip_records(f, begin: int, end: int) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(start, record, None) of the members that begin in a range, and (start, None, reason) where one was due and does not decode."""
    at, due = begin, begin == 0
    while at < end:
        here = _find(f, MAGIC, at, end)
        if due and here != at:
            yield at, None, "no gzip member"
        if here is None:
            return
        record, after, reason = _inflated(f, here)
        if record is None:
            if due and here == at:
                yield here, None, reason
            at, due = here + 1, False
            continue
        if record:  # an empty member only pads
            yield here, record, None
        at, due = after, True


def _plain_records(f, begin: int, end: int) -> Iterator[tuple[int, bytes | None, str | None]]:
    """As _gzip_records, for an uncompressed archive: a record is its headers, as many bytes as they say, and a blank line."""
    line = b"\n" + _VERSION
    at, due = begin, begin == 0
    while at < end:
        if not due:
            found = _find(f, line, at - 1, end - 1)
            if found is None:
                return
            at = found + 1
        f.seek(at)
        head = b""
        while b"\r\n\r\n" not in head and len(head) < 1 << 20 and (data := f.read(1 << 13)):
            head += data
        head, blank, _ = head.partition(b"\r\n\r\n")
        size = re.search(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*(?:\r\n|$)", head, re.IGNORECASE)
        reason = None if head.startswith(_VERSION) and blank and size else "no headers of a record"
        if reason is None:
            whole = len(head) + 4 + int(size[1])
            f.seek(at + len(head) + 4)
            record = head + blank + f.read(int(size[1]))
            ends = f.read(4 + len(_VERSION))
            if len(record) < whole:
                reason = "breaks off"
            elif ends and not (ends.startswith(b"\r\n\r\n") and (len(ends) == 4 or ends.endswith(_VERSION))):
                reason = "no record where its length ends"
        if reason is None:
            yield at, record, None
            at, due = at + whole + 4, True
        else:
            if due:
                yield at, None, reason
            at, due = at + 1, False


def _by_ranges(spark: SparkSession, files: list[tuple[str, int]], damaged: bool) -> DataFrame:
    spark.dataSource.register(_Ranges)
    options = {"files": len(files), "damaged": str(damaged).lower(),
               "range": spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()}
    for i, (uri, size) in enumerate(files):
        options |= {f"path{i}": uri, f"bytes{i}": size}
    return spark.read.format("warc_ranges").options(**options).load()


def _sorted_files(spark: SparkSession, path: str) -> tuple[list[tuple[str, int]], list[str]]:
    """(files named *.gz or *.warc with their sizes, the other ones); empty files hold nothing."""
    files = [(uri, size) for uri, size in files_under(spark, path) if size]
    def named(uri: str) -> bool:
        return uri.lower().endswith((".gz", ".warc"))

    return [x for x in files if named(x[0])], [uri for uri, _ in files if not named(uri)]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, headers, block for every WARC record of the archives under path: gzip members or, in *.warc files, also uncompressed.

    Damaged members are left out (see damaged_members). A *.gz or *.warc file that does not begin with a record is an error.
    """
    ranged, others = _sorted_files(spark, path)
    parts = ([_by_ranges(spark, ranged, False).select("file", "headers", "block")] if ranged else []) + ([_by_pieces(spark, others)] if others else [])
    if not parts:
        return spark.createDataFrame([], RECORD)
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def damaged_members(spark: SparkSession, path: str) -> DataFrame:
    """file, start, reason for every place in *.gz and *.warc files where a record was due and none could be read."""
    ranged, _ = _sorted_files(spark, path)
    if not ranged:
        return spark.createDataFrame([], "file string, start bigint, reason string")
    return _by_ranges(spark, ranged, True).select("file", "start", "reason")


def page_records(records: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest of the records that write_archives wrote.

    A response's size and digest are taken from the payload read back; a revisit's from its headers, its payload is null.
    """
    h = F.col("headers")
    # The HTTP head is ASCII and ends at the first blank line.
    cut = F.locate("\r\n\r\n", F.col("block").cast("string"))
    head = F.substring(F.col("block"), F.lit(1), cut + 3).cast("string")
    response = h["WARC-Type"] == "response"
    rows = records.select(
        h["X-Page-ID"].try_cast("bigint").alias("page_id"), h["WARC-Target-URI"].alias("url"),
        h["WARC-Type"].alias("record_type"), h["X-Refers-To-Page"].try_cast("bigint").alias("refers_to"),
        F.when(response, F.substring(F.col("block"), cut + 4, F.octet_length("block"))).alias("payload"),
        F.regexp_extract(head, r"Content-Length: (\d+)", 1).try_cast("bigint").alias("stated"),
        F.regexp_replace(h["WARC-Payload-Digest"], "^sha256:", "").alias("digest"))
    return rows.select("page_id", "url", "record_type", "refers_to", "payload",
                       F.coalesce(F.octet_length("payload").cast("bigint"), "stated").alias("payload_bytes"),
                       F.coalesce(F.sha2("payload", 256), "digest").alias("payload_digest"))
