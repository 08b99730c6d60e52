"""Frames derived from the driver tables (``events`` + ``embeddings``).

Each event is a camera frame of user ``user_id`` at UTC instant ``ts``; its pose
landmarks are the first 12 embedding coordinates of vector ``event_id mod n``
(``n`` = number of embeddings; an event without such a vector has no landmarks), and ``error`` events stand for frames where no
pose was found.  The message view renders the frame as the producer would: a
KST timestamp text and the image bytes (here the UTF-8 of ``props``) as hex.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import encode_hex
from ..functions.timeparts import DEFAULT_TZ, instant_range, message_ts_text
from ..schemas import EMBEDDINGS, EVENTS
from .tables import read_table

LANDMARK_WIDTH = 12  # LS xyz, RS xyz, LE xyz, RE xyz


Days = tuple[dt.date, dt.date] | None


def event_frames(spark: SparkSession, sf_dir: str, days: Days = None, tz: str = DEFAULT_TZ) -> DataFrame:
    """The frames without landmarks: ``events`` alone, no join.  ``days`` (first, last): a
    report's local dates, pushed to the scan as a range of instants that holds them."""
    ev = read_table(spark, sf_dir, "events", EVENTS)
    if days:
        ev = ev.filter(instant_range("ts", *days, tz=tz, ntz=True))
    return ev.select("event_id", "user_id", "ts", "event_type", "props")


def frames(spark: SparkSession, sf_dir: str, days: Days = None) -> DataFrame:
    """``event_id, user_id, ts (UTC, NTZ), event_type, props, lm array<double>``.

    The lookup is a plain equi-join on ``vec_id`` (uniform keys; Catalyst/AQE
    choose the strategy by the measured size of ``embeddings``).  The embedding
    count is taken once when the plan is built (a single number, answered from
    parquet metadata) and enters as a literal: a scalar subquery would get a
    fresh id in every branch of a plan and block the reuse of shared shuffles.
    """
    ev = event_frames(spark, sf_dir, days)
    emb = read_table(spark, sf_dir, "embeddings", EMBEDDINGS).select("vec_id", "embedding")
    n = emb.count()
    key = F.pmod(F.col("event_id"), F.lit(n)) if n else F.lit(None).cast("long")
    ev = ev.withColumn("vec_key", key)
    j = ev.join(emb, ev.vec_key == emb.vec_id, "left")
    lm = F.when(F.col("event_type") != "error",
                F.slice("embedding", 1, LANDMARK_WIDTH).cast("array<double>"))
    return j.select("event_id", "user_id", "ts", "event_type", "props", lm.alias("lm"))


def frame_messages(spark: SparkSession, sf_dir: str, tz: str = DEFAULT_TZ,
                   corrupt: bool = False) -> DataFrame:
    """``event_id, user_id, ts, timestamp STRING, image_data STRING`` (hex of props).

    With ``corrupt``: ``event_id % 50`` = 0 -> NULL image, 1 -> image ``zz``,
    2 -> timestamp ``bad`` (inputs for the quarantine path).
    """
    ev = read_table(spark, sf_dir, "events", EVENTS).select("event_id", "user_id", "ts", "props")
    ts_text = message_ts_text("ts", tz)
    image = encode_hex(F.encode("props", "UTF-8"))
    if corrupt:
        k = F.col("event_id") % 50
        image = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit("zz")).otherwise(image)
        ts_text = F.when(k == 2, F.lit("bad")).otherwise(ts_text)
    return ev.select("event_id", "user_id", "ts", ts_text.alias("timestamp"),
                     image.alias("image_data"))


def message_values(messages: DataFrame) -> DataFrame:
    """Stream-record view: ``event_id, value BINARY`` holding the message JSON."""
    js = F.to_json(F.struct("timestamp", "image_data"), {"ignoreNullFields": "false"})
    return messages.select("event_id", F.encode(js, "UTF-8").alias("value"))
