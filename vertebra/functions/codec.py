"""Message codecs: hex, base64, data URLs, JSON, file names, surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def decode_hex(col: Column | str) -> Column:
    """Hex text -> bytes. Whitespace is ignored; odd length or a bad digit -> NULL.

    (``unhex`` alone would left-pad odd input with a zero nibble.)
    """
    s = F.regexp_replace(_c(col), r"\s+", "")
    return F.when(F.length(s) % 2 == 0, F.unhex(s))


def encode_hex(col: Column | str) -> Column:
    """Bytes -> lower-case hex (Spark's ``hex`` is upper-case)."""
    return F.lower(F.hex(_c(col)))


def data_url_payload(col: Column | str) -> Column:
    """Second comma field of a data URL (``header,payload``); NULL when absent."""
    return F.get(F.split(_c(col), ","), 1)


def decode_base64(col: Column | str) -> Column:
    """Base64 text -> bytes; undecodable or empty -> NULL."""
    b = F.try_to_binary(_c(col), F.lit("base64"))
    return F.when(F.octet_length(b) > 0, b)


def image_size(col: Column | str) -> Column:
    return F.octet_length(_c(col))


def to_json_keep_nulls(*cols: Column) -> Column:
    """JSON object of the given aliased columns, nulls written as ``null``."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def surrogate_key(*cols: Column | str) -> Column:
    """Deterministic id (SHA-256 hex) of the key parts; stable across task retries."""
    return F.sha2(F.concat_ws("|", *[_c(c).cast("string") for c in cols]), 256)


def archive_name(ts_text: Column | str) -> Column:
    """``kafka_<timestamp with ':'->'-' and ' '->'_'>.json``."""
    return F.concat(F.lit("kafka_"), F.translate(_c(ts_text), ": ", "-_"), F.lit(".json"))


def relative_path(path: Column | str, prefix: str) -> Column:
    """Strip a storage prefix from a path (paths without it are kept whole)."""
    p = _c(path)
    return F.when(p.startswith(prefix), p.substr(F.lit(len(prefix) + 1), F.length(p))).otherwise(p)


def file_basename(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]+)$", 1)


def average_image_name(posture: Column, year: Column, month: Column, day: Column) -> Column:
    """``average_{correct|incorrect}_{y}-{m}-{d}.png`` without zero padding."""
    return F.format_string("average_%s_%d-%d-%d.png",
                           F.when(posture, F.lit("correct")).otherwise(F.lit("incorrect")),
                           year, month, day)
