"""Explicit StructTypes for every input, stored table and result."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField(a, T.DoubleType()) for a in ("x", "y", "z")])

# landmark set: left/right shoulder, left/right ear; NULL = no pose found
LANDMARKS = T.StructType([T.StructField(p, POINT) for p in ("ls", "rs", "le", "re")])

# frame message as produced by the camera backend (JSON text in the stream value)
FRAME_MESSAGE = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("image_data", T.StringType()),
])

ANALYSIS_RESULT = T.StructType([
    T.StructField("cva_left", T.DoubleType()),
    T.StructField("cva_right", T.DoubleType()),
    T.StructField("fha_left", T.DoubleType()),
    T.StructField("fha_right", T.DoubleType()),
    T.StructField("posture_correct", T.BooleanType()),
])

# document written to the landing zone by the live path; ``lm`` (the flat
# landmark array) is an addition so the loader can feed the daily mart without
# a second inference pass; documents without it are still accepted
LANDED_DOCUMENT = T.StructType([
    T.StructField("image_data", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("analysis_result", ANALYSIS_RESULT),
    T.StructField("lm", T.ArrayType(T.DoubleType())),
])

TB_POSTURE = T.StructType([
    T.StructField("posture_id", T.StringType(), False),
    T.StructField("img_filename", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("cva_left_value", T.DoubleType()),
    T.StructField("cva_right_value", T.DoubleType()),
    T.StructField("fha_left_value", T.DoubleType()),
    T.StructField("fha_right_value", T.DoubleType()),
    T.StructField("posture_status", T.BooleanType()),
    T.StructField("day_id", T.IntegerType()),
    T.StructField("week_id", T.IntegerType()),
    T.StructField("month_id", T.IntegerType()),
    T.StructField("year_id", T.IntegerType()),
    T.StructField("timestamp", T.TimestampType()),
])

TB_IMAGE = T.StructType([
    T.StructField("img_id", T.StringType(), False),
    T.StructField("img_filename", T.StringType(), False),
    T.StructField("capture_time", T.TimestampType()),
    T.StructField("file_size", T.IntegerType()),
])

TB_USER = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("user_name", T.StringType()),
    T.StructField("user_age", T.IntegerType()),
    T.StructField("user_gender", T.StringType()),
])

TB_YEAR = T.StructType([T.StructField("year_id", T.IntegerType()),
                        T.StructField("year_value", T.IntegerType())])
TB_MONTH = T.StructType([T.StructField("month_id", T.IntegerType()),
                         T.StructField("month_value", T.StringType()),
                         T.StructField("year_id", T.IntegerType())])
TB_WEEK = T.StructType([T.StructField("week_id", T.IntegerType()),
                        T.StructField("week_value", T.IntegerType()),
                        T.StructField("year_id", T.IntegerType())])
# year_id added so that (year, month, day) is a real key
TB_DAY = T.StructType([T.StructField("day_id", T.IntegerType()),
                       T.StructField("day_value", T.StringType()),
                       T.StructField("month_id", T.IntegerType()),
                       T.StructField("week_id", T.IntegerType()),
                       T.StructField("year_id", T.IntegerType())])

POINT_NAMES = ("left_shoulder", "right_shoulder", "left_ear", "right_ear", "c7")
AXES = ("x", "y", "z")
AVG_COLUMNS = tuple(f"avg_{p}_{a}" for p in POINT_NAMES for a in AXES)

TB_DAILY_STAT = T.StructType(
    [T.StructField("daily_stat_id", T.StringType()),
     T.StructField("year_id", T.IntegerType()),
     T.StructField("month_id", T.IntegerType()),
     T.StructField("day_id", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in AVG_COLUMNS]
    + [T.StructField("posture_correct", T.BooleanType()),
       T.StructField("img_filename", T.StringType()),
       T.StructField("cnt", T.LongType())])

# driver input tables read by the frame fixture (explicit: no footer-based inference)
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
EMBEDDINGS = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])
