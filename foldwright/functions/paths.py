"""Path and fingerprint helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_path(c: Column | str) -> Column:
    """Collapse '//', '/./', 'name/..' and a trailing '/', purely by text."""
    c = _col(c)
    absolute = c.startswith("/")
    parts = F.filter(F.split(c, "/"), lambda x: (x != "") & (x != "."))
    # A '..' removes the nearest kept name; at the root it vanishes, in a relative path it stays.
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x)))
        .when((F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("")) != ".."),
              F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(absolute, acc)
        .otherwise(F.concat(acc, F.array(x))),
    )
    body = F.concat_ws("/", kept)
    return F.when(absolute, F.concat(F.lit("/"), body)).when(body == "", ".").otherwise(body)


def file_name(c: Column | str) -> Column:
    return F.substring_index(_col(c), "/", -1)


def suffix(c: Column | str) -> Column:
    """Lower-case extension without the dot, empty when there is none."""
    return F.lower(F.regexp_extract(file_name(c), r"^.+\.([^.]+)$", 1))


def rebase(c: Column | str, src: str, dst: str) -> Column:
    """Move a path from under src to under dst, keeping the sub-folders."""
    c = _col(c)
    src, dst = src.rstrip("/"), dst.rstrip("/")
    inside = c.startswith(src + "/")
    return F.when(inside, F.concat(F.lit(dst), F.substring(c, len(src) + 1, 1 << 30))).otherwise(c)


def hex_to_bits(c: Column | str) -> Column:
    """16 hex digits -> signed 64-bit integer."""
    return F.conv(_col(c), 16, -10).cast("bigint")


def bits_to_hex(c: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(_col(c))), 16, "0")


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def short_digest(c: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of a string or binary column."""
    return F.substring(F.sha2(_col(c), 256), 1, 16)
