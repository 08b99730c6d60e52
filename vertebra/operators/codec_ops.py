"""Producer-side encoding and the live result feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import (archive_name, data_url_payload, decode_base64, encode_hex,
                               to_json_keep_nulls)
from ..functions.timeparts import DEFAULT_TZ, message_ts_text
from .posture import RESULT_FIELDS


def encode_frames(df: DataFrame, data_url: str = "image", ts: str = "ts", tz: str = DEFAULT_TZ,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Browser post (data URL) + capture instant -> message ``value`` JSON text.

    Payload extraction and base64 failures give a NULL ``image_data`` instead
    of an exception; the decoder then drops or quarantines the row.
    """
    raw = decode_base64(data_url_payload(data_url))
    msg = to_json_keep_nulls(message_ts_text(ts, tz).alias("timestamp"),
                             encode_hex(raw).alias("image_data"))
    return df.select(*keep, msg.alias("value"))


def encode_frames_checked(df: DataFrame, data_url: str = "image", ts: str = "ts",
                          tz: str = DEFAULT_TZ, keep: tuple[str, ...] = ()
                          ) -> tuple[DataFrame, DataFrame]:
    """(messages, quarantined posts): a post without a payload field, or whose
    payload is not base64, is set aside with its ``reason`` instead of being
    sent on with an empty image."""
    payload = data_url_payload(data_url)
    reason = (F.when(payload.isNull(), F.lit("bad_data_url"))
              .when(decode_base64(payload).isNull(), F.lit("bad_base64")))
    checked = df.withColumn("reason", reason)
    good = encode_frames(checked.filter(F.col("reason").isNull()), data_url, ts, tz, keep)
    bad = checked.filter(F.col("reason").isNotNull()).select(*keep, data_url, ts, "reason")
    return good, bad


def result_feed(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON object of the five analysis fields per frame (nulls kept)."""
    return df.select(*keep, to_json_keep_nulls(*[F.col(c) for c in RESULT_FIELDS]).alias("value"))


def archive_frames_names(messages: DataFrame, ts: str = "ts", text: str = "timestamp",
                         tz: str = DEFAULT_TZ, keep: tuple[str, ...] = ()) -> DataFrame:
    """Archive folder (``yyyyMMdd`` in ``tz``) and file name per message."""
    day = F.date_format(F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz), "yyyyMMdd")
    return messages.select(*keep, day.alias("ingest_date"), archive_name(text).alias("archive_name"))


def archive_rows(messages: DataFrame, ts: str = "event_ts", tz: str = DEFAULT_TZ) -> DataFrame:
    """Messages as they are archived: ``ingest_date`` (local day of the frame, NULL if the
    message has none), the per-message name, and the message (``raw`` where it could not be decoded)."""
    day = F.date_format(F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz), "yyyyMMdd")
    return (messages.withColumns({"ingest_date": day, "archive_name": archive_name("timestamp")})
            .select("ingest_date", "archive_name", "timestamp", "image_data", *[c for c in ("raw",) if c in messages.columns]))


def preview(df: DataFrame, order: tuple[str, ...], n: int = 20) -> DataFrame:
    """First ``n`` rows in a fixed order (top-n, not a full sort)."""
    return df.orderBy(*order).limit(n)
