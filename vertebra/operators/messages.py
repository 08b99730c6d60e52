"""Message decoding, null filtering and quarantine of undecodable rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import decode_hex
from ..functions.timeparts import parse_message_ts
from ..schemas import FRAME_MESSAGE


def decode_messages(df: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``value BINARY`` -> ``timestamp, image_data`` (+ ``json_ok`` flag, ``raw``, kept columns).

    Malformed JSON gives NULL fields with ``json_ok = false`` instead of an error, and its
    text in ``raw`` (NULL for a good message).
    """
    schema = T.StructType(FRAME_MESSAGE.fields + [T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(F.col(value).cast("string"), schema,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    ok = F.col("_m").isNotNull() & F.col("_m._corrupt").isNull()
    return (df.select(*keep, parsed.alias("_m"), F.col(value).cast("string").alias("_text"))
              .select(*keep, "_m.timestamp", "_m.image_data", ok.alias("json_ok"),
                      F.when(~ok, F.col("_text")).alias("raw")))


def nonnull_frames(df: DataFrame, image: str = "image_data") -> DataFrame:
    """Frames that carry an image."""
    return df.filter(F.col(image).isNotNull())


def with_validation(df: DataFrame, image: str = "image_data", ts: str = "timestamp") -> DataFrame:
    """Add ``image``, ``event_ts`` (UTC instant) and ``reason`` (NULL when valid)."""
    img = decode_hex(image)
    inst = parse_message_ts(ts)
    json_ok = F.col("json_ok") if "json_ok" in df.columns else F.lit(True)
    reason = (F.when(~json_ok, F.lit("bad_json"))
              .when(F.col(image).isNull(), F.lit("null_image"))
              .when(img.isNull() | (F.octet_length(img) == 0), F.lit("bad_hex"))
              .when(inst.isNull(), F.lit("bad_timestamp")))
    return df.withColumns({"image": img, "event_ts": inst, "reason": reason})


def split_valid(df: DataFrame, image: str = "image_data", ts: str = "timestamp"
                ) -> tuple[DataFrame, DataFrame]:
    """(good, bad) halves; a bad row never takes other rows down with it.

    Rows without an image are dropped (not quarantined), like the batch job's
    null filter; every other failure goes to ``bad`` with its ``reason``.
    """
    json_ok = F.col("json_ok") if "json_ok" in df.columns else F.lit(True)
    v = with_validation(df.filter(F.col(image).isNotNull() | ~json_ok), image, ts)
    return v.filter(F.col("reason").isNull()).drop("reason"), v.filter(F.col("reason").isNotNull())
