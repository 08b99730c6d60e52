"""WARC archives: writing captures, reading them back, and assembling transactions.

A capture is three records: request, response (or revisit) and metadata.  The request and
the metadata name the response record in ``WARC-Concurrent-To``; records are read in any
order and joined through these identifiers to one nested row per capture.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
#: Payloads under this size are never written as revisits.
LEAST = 100
#: Captures of an archive file; files stay small enough for one task to hold.
PER_FILE = 4000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("warc_type string, record_id string, concurrent_to string, uri string, date string, payload_bytes long, "
          "payload_digest string, status string, fields map<string,string>, payload binary")


def _record_id(kind: str, uid: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), uid).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
                                          for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]])


def _record(kind: str | Column, ident: Column, uri: Column, block: Column, more: list[tuple[str, Column]]) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = [F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <"), ident, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri]
    for name, value in more:  # a null value leaves the header out
        head.append(F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")))
    return F.concat(*head, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> None:
    """Write a capture per row of ``pages`` (page_id, url, html) as gzipped WARC/1.1 files.

    The payload is the html in UTF-8 (null: empty).  Of captures with equal payloads of
    ``least`` bytes or more, the one with the smallest page_id is a response and the
    others are revisits without payload (rows that repeat that page_id and payload are
    responses too; a null page_id comes after all others).  Control characters and spaces
    of a url are percent-encoded; a null url becomes ``about:blank``.
    """
    html = F.coalesce("html", F.lit(""))
    digest = F.sha2(html.cast("binary"), 256)
    size = F.octet_length(html)
    order = F.struct(F.col("page_id").isNull().alias("no"), F.col("page_id").alias("id"))
    again = (pages.where(size >= least).select(digest.alias("d"), order.alias("o"))
             .groupBy("d").agg(F.min("o").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first"))
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("about:blank"))
    rows = (pages.select("page_id", uri.alias("uri"), html.alias("html"), digest.alias("digest"), order.alias("o"),
                         F.when(size >= least, digest).alias("key"))
            .join(again, F.col("key") == F.col("d"), "left")
            .withColumn("revisit", F.col("first").isNotNull() & (F.col("first") != F.col("o")))
            .withColumn("uid", F.concat_ws("-", "page_id", F.monotonically_increasing_id())))
    resp = _record_id("response", F.col("uid"))
    path = F.concat(F.lit("/"), F.regexp_extract("uri", r"^[^/]*//[^/]*/(.*)$", 1))
    host = F.regexp_extract("uri", r"^[^/]*//([^/]*)", 1)
    request = _record("request", _record_id("request", F.col("uid")), F.col("uri"),
                      F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)),
                      [("WARC-Concurrent-To", F.concat(F.lit("<"), resp, F.lit(">"))),
                       ("Content-Type", F.lit("application/http; msgtype=request"))])
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
                    F.octet_length("html").cast("string"), F.lit(END))
    response = _record(F.when(F.col("revisit"), "revisit").otherwise("response"), resp, F.col("uri"),
                       F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("html"))),
                       [("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
                        ("WARC-Profile", F.when(F.col("revisit"), F.lit(_PROFILE))),
                        ("Content-Type", F.lit("application/http; msgtype=response"))])
    metadata = _record("metadata", _record_id("metadata", F.col("uid")), F.col("uri"),
                       F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("\r\n")),
                       [("WARC-Concurrent-To", F.concat(F.lit("<"), resp, F.lit(">"))),
                        ("Content-Type", F.lit("application/warc-fields"))])
    (rows.select(F.concat_ws(END, request, response, metadata).alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(folder))


def _headers(stream: io.BufferedIOBase) -> dict[str, str]:
    out: dict[str, str] = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.partition(b":")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, framed by Content-Length."""
    while line := stream.readline():
        if line.startswith(b"WARC/"):
            head = _headers(stream)
            yield head, stream.read(int(head.get("content-length", 0)))


def parse(head: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """One row of ``RECORD``; the digest of a response is taken from its payload."""
    kind, status, size, digest, payload = head.get("warc-type"), None, None, None, None
    fields: list[tuple[str, str]] = []
    if kind in ("response", "revisit"):
        http, _, body = block.partition(b"\r\n\r\n")
        first, _, _ = http.partition(b"\r\n")
        status = first.decode("utf-8", "replace")
        if kind == "response":
            size, digest = len(body), hashlib.sha256(body).hexdigest()
            payload = body if payloads else None
        else:
            digest = head.get("warc-payload-digest", "").rpartition(":")[2] or None
    elif kind == "request":
        status = block.partition(b"\r\n")[0].decode("utf-8", "replace")
    elif kind == "metadata":
        fields = list(_headers(io.BytesIO(block)).items())
    strip = lambda x: x and x.strip("<>")
    return (kind, strip(head.get("warc-record-id")), strip(head.get("warc-concurrent-to")), head.get("warc-target-uri"),
            head.get("warc-date"), size, digest, status, fields, payload)


_ARROW = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("uri", pa.string()),
                    ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("status", pa.string()),
                    ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in ``folder`` (``RECORD``).  Without ``payloads`` that
    column is null, but sizes and digests are still those of the payloads read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_buffer())
                zipped = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                rows, held = [], 0
                for head, block in records(gzip.GzipFile(fileobj=raw) if zipped else raw):
                    rows.append(parse(head, block, payloads))
                    held += len(block)
                    if held > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(recs: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response, metadata.

    ``response`` is the response or revisit record; requests and metadata come with the
    record that they are concurrent to (the smallest record_id, should several be).  A
    capture whose response is missing has null there; a response without request or
    metadata has nulls there.  Requests and metadata without any identifier share one row.
    """
    body = F.struct("record_id", "uri", "date", "status", "warc_type", "payload_bytes", "payload_digest", "payload")
    kind = F.col("warc_type")
    own = kind.isin("response", "revisit")
    keyed = recs.select(F.when(own, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")).alias("capture_id"), "*")
    left = keyed.where(own).select("capture_id", body.alias("response"))
    # one scan for both: every branch reads and parses the archives again
    asked = F.when(kind == "request", F.struct("record_id", "uri", "date", "status"))
    said = F.when(kind == "metadata", F.struct("record_id", F.map_entries("fields").alias("f")))
    beside = (keyed.where(kind.isin("request", "metadata")).groupBy("capture_id").agg(F.min(asked).alias("request"), F.min(said).alias("m"))
              .select("capture_id", "request", F.when(F.col("m").isNotNull(), F.struct(
                  F.col("m.record_id").alias("record_id"), F.map_from_entries("m.f").alias("fields"))).alias("metadata")))
    return left.join(beside, "capture_id", "full").select("capture_id", "request", "response", "metadata")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Adds page_id, payload_bytes, payload_digest, record_type and refers_to: a revisit
    takes size and page from the response of its digest (the smallest page_id)."""
    flat = captures.select("*", F.col("metadata.fields")["page_id"].cast("long").alias("page_id"),
                           F.col("response.payload_digest").alias("payload_digest"),
                           F.col("response.warc_type").alias("record_type"))
    full = (flat.where("record_type = 'response'")
            .groupBy("payload_digest").agg(F.min("page_id").alias("of"), F.max("response.payload_bytes").alias("size"))
            .withColumnRenamed("payload_digest", "d"))
    back = F.col("record_type") == "revisit"
    key = F.when(back, F.col("payload_digest"))
    return (flat.join(full, key == F.col("d"), "left")
            .withColumn("payload_bytes", F.when(back, F.col("size")).otherwise(F.col("response.payload_bytes")))
            .withColumn("refers_to", F.when(back, F.col("of"))).drop("d", "of", "size"))


def op5(pages: DataFrame) -> DataFrame:
    """Writes the archives of ``pages`` to the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write_archives(pages.select("page_id", "url", "html"), folder)
    captures = resolve_revisits(assemble(read_archives(spark, folder, payloads=False)))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_OP5 = f"""
WITH p AS (
  SELECT page_id, CAST(octet_length(CAST(encode(coalesce(html, '')) AS BLOB)) AS BIGINT) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS of FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST} AND page_id <> of THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND page_id <> of THEN of END AS refers_to
FROM p JOIN f USING (payload_digest)
"""
