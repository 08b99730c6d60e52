"""Registered queries: each takes (spark, sf_dir) and returns a lazy DataFrame.

All of them read the whole ``events`` / ``embeddings`` tables (frames derived
from them); report parameters are fixed dates inside the data's range.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import decode_hex, encode_hex
from ..functions.timeparts import DEFAULT_TZ, LOCAL_TS_PATTERN, local_time, parse_message_ts
from ..operators import mart as mart_ops
from ..operators import reports, status, warehouse
from ..operators.codec_ops import archive_frames_names, encode_frames, preview, result_feed
from ..operators.messages import decode_messages, nonnull_frames, split_valid
from ..operators.posture import analyze, with_c7, with_landmarks
from ..sources.fixtures import Days, event_frames, frame_messages, frames, message_values

# fixed query parameters
TZ = DEFAULT_TZ
REPORT_DAY = dt.date(2024, 1, 2)
WEEK_END = dt.date(2024, 1, 31)
CAL_YEAR = 2024
# the local dates that the reports can use
CAL_DATES = (dt.date(CAL_YEAR, 1, 1), dt.date(CAL_YEAR, 12, 31))  # also all that the literal week takes
WEEK_DATES = (WEEK_END - dt.timedelta(days=reports.WEEK_DAYS), WEEK_END)
TODAY = dt.date(2024, 1, 31)
UPSERT_CUTOFF = dt.date(2024, 1, 15)
DATA_URL_HEADER = "data:image/jpeg;base64,"


# ---- shared derivations ------------------------------------------------------

def analyzed(spark: SparkSession, sf_dir: str, days: Days = None) -> DataFrame:
    return analyze(with_landmarks(frames(spark, sf_dir, days)))


def facts(spark: SparkSession, sf_dir: str, days: Days = None) -> DataFrame:
    """The facts; with ``days``, those a report on these local dates needs (and some more)."""
    return warehouse.to_facts(analyzed(spark, sf_dir, days), key="event_id", ts="ts", user="user_id", tz=TZ)


def mart(spark: SparkSession, sf_dir: str, days: Days = None) -> DataFrame:
    return mart_ops.daily_stat(facts(spark, sf_dir, days))


def decoded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = frame_messages(spark, sf_dir, TZ)
    return m.withColumn("image", decode_hex("image_data"))


def _ntz(c):
    return F.col(c).cast("timestamp_ntz") if isinstance(c, str) else c.cast("timestamp_ntz")


# ---- codec / ingest ----------------------------------------------------------

def q_decode_messages(spark, sf_dir):
    vals = message_values(frame_messages(spark, sf_dir, TZ))
    d = decode_messages(vals, keep=("event_id",))
    return d.select("event_id", "timestamp", "image_data",
                    _ntz(parse_message_ts("timestamp")).alias("event_ts"), "json_ok")


def q_nonnull_frames(spark, sf_dir):
    m = frame_messages(spark, sf_dir, TZ, corrupt=True)
    return nonnull_frames(m).select("event_id", "timestamp", "image_data")


def q_quarantine(spark, sf_dir):
    vals = message_values(frame_messages(spark, sf_dir, TZ, corrupt=True))
    _, bad = split_valid(decode_messages(vals, keep=("event_id",)))
    return bad.select("event_id", "reason")


def q_decode_hex(spark, sf_dir):
    d = decoded_images(spark, sf_dir)
    return d.select("event_id", F.octet_length("image").alias("n_bytes"),
                    F.col("image").cast("string").alias("text"))


def q_encode_frames(spark, sf_dir):
    ev = event_frames(spark, sf_dir)
    post = ev.select("event_id", "ts",
                     F.concat(F.lit(DATA_URL_HEADER), F.base64(F.encode("props", "UTF-8"))).alias("image"))
    return encode_frames(post, "image", "ts", TZ, keep=("event_id",))


def q_surrogate_keys(spark, sf_dir):
    ev = event_frames(spark, sf_dir)
    ids = warehouse.frame_ids("event_id", "ts", TZ)
    return ev.select("event_id", *[ids[k].alias(k) for k in ("posture_id", "img_id", "img_filename")])


def q_archive_names(spark, sf_dir):
    m = frame_messages(spark, sf_dir, TZ)
    return archive_frames_names(m, keep=("event_id",))


def q_preview(spark, sf_dir):
    m = frame_messages(spark, sf_dir, TZ)
    return preview(m.select("event_id", "ts", "timestamp", "image_data"), ("ts", "event_id")) \
        .select("event_id", "timestamp", "image_data")


def q_ingest_counts(spark, sf_dir):
    return mart_ops.ingest_counts(frame_messages(spark, sf_dir, TZ), "ts", TZ)


# ---- per-frame analysis ------------------------------------------------------

def q_calendar_parts(spark, sf_dir):
    from ..functions.timeparts import calendar_parts
    ev = event_frames(spark, sf_dir).select("event_id", "ts")
    return calendar_parts(ev, "ts", TZ).select(
        "event_id", "year_id", "month_id", "day_id", "week_id", "iso_year", "month_value",
        "day_value", F.date_format(local_time("ts", TZ), LOCAL_TS_PATTERN).alias("local_ts"))


def q_c7(spark, sf_dir):
    d = with_c7(with_landmarks(frames(spark, sf_dir)))
    return d.select("event_id", F.col("c7.x").alias("c7_x"), F.col("c7.y").alias("c7_y"),
                    F.col("c7.z").alias("c7_z"))


def q_angles(spark, sf_dir):
    return analyzed(spark, sf_dir).select("event_id", "cva_left", "cva_right", "fha_left", "fha_right")


def q_posture(spark, sf_dir):
    return analyzed(spark, sf_dir).select("event_id", "user_id", "posture_correct")


def q_result_feed(spark, sf_dir):
    return result_feed(analyzed(spark, sf_dir), keep=("event_id",))


def q_status_label(spark, sf_dir):
    a = analyzed(spark, sf_dir)
    return a.select("event_id", "posture_correct", status.status_label("posture_correct").alias("status_label"))


def q_status_carry(spark, sf_dir):
    a = analyzed(spark, sf_dir).withColumn("status_label", status.status_label("posture_correct"))
    return status.status_carry(a).select("event_id", "user_id", "status")


def q_live_status(spark, sf_dir):
    a = analyzed(spark, sf_dir).withColumn("status_label", status.status_label("posture_correct"))
    return status.live_status(a).withColumn("ts", _ntz("ts"))


# ---- warehouse ---------------------------------------------------------------

def q_image_dim(spark, sf_dir):
    im = warehouse.to_images(decoded_images(spark, sf_dir), "event_id", "ts", "image", TZ)
    return im.withColumn("capture_time", _ntz("capture_time"))


def q_user_dim(spark, sf_dir):
    return warehouse.user_dim(facts(spark, sf_dir))


def _dim(name):
    def q(spark, sf_dir):
        return warehouse.calendar_dims(facts(spark, sf_dir), TZ)[name]
    q.__name__ = f"q_dim_{name}"
    return q


def q_dim_upsert(spark, sf_dir):
    f = facts(spark, sf_dir)
    incoming = warehouse.calendar_dims(f, TZ)["day"]
    # the stored dimension as a load before the cutoff day would have left it
    existing = incoming.filter(F.make_date("year_id", "month_id", "day_id") < F.lit(UPSERT_CUTOFF))
    return warehouse.merged_dim(existing, incoming, warehouse.DIM_KEYS["day"])


def q_star_join(spark, sf_dir):
    image = decode_hex(encode_hex(F.encode("props", "UTF-8")))  # as the message carries it
    s = warehouse.star_frames(analyzed(spark, sf_dir).withColumn("image", image), "event_id", "ts", "user_id", "image", TZ)
    return s.select("posture_id", "user_id", "user_name", "year_value", "month_value",
                    "week_value", "day_value", "file_size")


def q_day_class_scan(spark, sf_dir):
    d = REPORT_DAY
    return warehouse.day_class(facts(spark, sf_dir, (d, d)), d.year, d.month, d.day)


# ---- mart and reports --------------------------------------------------------

def q_daily_stat(spark, sf_dir):
    return mart(spark, sf_dir)


def q_calendar_days(spark, sf_dir):
    return reports.calendar_days(mart(spark, sf_dir, CAL_DATES), CAL_YEAR)


def q_calendar_map(spark, sf_dir):
    m = reports.calendar_map(mart(spark, sf_dir, CAL_DATES), CAL_YEAR)
    return m.select("year_id", "month_id", F.array_join("days", ",").alias("days"))


def q_daily_report(spark, sf_dir):
    return reports.daily_report(mart(spark, sf_dir, (REPORT_DAY, REPORT_DAY)), REPORT_DAY)


def q_daily_score(spark, sf_dir):
    return reports.daily_scores(mart(spark, sf_dir))


def q_weekly_score(spark, sf_dir):
    return reports.weekly_score(mart(spark, sf_dir, WEEK_DATES), WEEK_END, "calendar")


def q_weekly_score_literal(spark, sf_dir):
    return reports.weekly_score(mart(spark, sf_dir, CAL_DATES), WEEK_END, "literal")


def q_weekly_landmarks(spark, sf_dir):
    return reports.weekly_landmarks(mart(spark, sf_dir, WEEK_DATES), WEEK_END, "calendar")


def q_weekly_landmarks_literal(spark, sf_dir):
    return reports.weekly_landmarks(mart(spark, sf_dir, CAL_DATES), WEEK_END, "literal")


def q_calendar_grid(spark, sf_dir):
    return reports.calendar_grid(mart(spark, sf_dir), TODAY)


def q_skeleton_segments(spark, sf_dir):
    return reports.skeleton_segments(mart(spark, sf_dir))


def q_capture_gaps(spark, sf_dir):
    from ..operators.cadence import capture_gaps
    return capture_gaps(event_frames(spark, sf_dir).select("event_id", "user_id", "ts"), tz=TZ)


def q_score_rollup(spark, sf_dir):
    return reports.score_rollup(mart(spark, sf_dir))


_RAW: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q_decode_messages": q_decode_messages,
    "q_nonnull_frames": q_nonnull_frames,
    "q_quarantine": q_quarantine,
    "q_decode_hex": q_decode_hex,
    "q_encode_frames": q_encode_frames,
    "q_surrogate_keys": q_surrogate_keys,
    "q_archive_names": q_archive_names,
    "q_preview": q_preview,
    "q_result_feed": q_result_feed,
    "q_status_label": q_status_label,
    "q_status_carry": q_status_carry,
    "q_live_status": q_live_status,
    "q_calendar_parts": q_calendar_parts,
    "q_c7": q_c7,
    "q_angles": q_angles,
    "q_posture": q_posture,
    "q_image_dim": q_image_dim,
    "q_user_dim": q_user_dim,
    "q_dim_year": _dim("year"),
    "q_dim_month": _dim("month"),
    "q_dim_week": _dim("week"),
    "q_dim_day": _dim("day"),
    "q_dim_upsert": q_dim_upsert,
    "q_star_join": q_star_join,
    "q_day_class_scan": q_day_class_scan,
    "q_daily_stat": q_daily_stat,
    "q_calendar_days": q_calendar_days,
    "q_calendar_map": q_calendar_map,
    "q_daily_report": q_daily_report,
    "q_daily_score": q_daily_score,
    "q_weekly_score": q_weekly_score,
    "q_weekly_score_literal": q_weekly_score_literal,
    "q_weekly_landmarks": q_weekly_landmarks,
    "q_weekly_landmarks_literal": q_weekly_landmarks_literal,
    "q_calendar_grid": q_calendar_grid,
    "q_skeleton_segments": q_skeleton_segments,
    "q_ingest_counts": q_ingest_counts,
    "q_score_rollup": q_score_rollup,
    "q_capture_gaps": q_capture_gaps,
}


def _utc(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Timestamps in the tables are UTC wall clocks; pin the session zone to UTC
    before the plan is analysed so results do not depend on the caller's zone."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _utc(v) for k, v in _RAW.items()}

