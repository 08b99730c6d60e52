"""Daily mart: mean body landmarks and frame counts per day and posture class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import average_image_name, surrogate_key
from ..functions.geometry import midpoint
from ..functions.numeric import exact_mean, round_half_even
from ..schemas import AXES, AVG_COLUMNS

# fixed value: the mart keeps means to 3 decimals
MEAN_DIGITS = 3

DAY_KEYS = ["year_id", "month_id", "day_id"]


def daily_stat(facts: DataFrame, by_user: bool = False) -> DataFrame:
    """``tb_daily_stat`` rows for every (day, class) present, in one aggregation.

    Frames without a pose are excluded.  Partial (map-side) aggregation means a
    hot day or user only ships one partial row per task through the shuffle.
    The means are exact sums over counts, so the mart is the same to the bit
    under any partitioning, and no 3-decimal tie depends on the order of rows.
    """
    lmk = F.col("landmarks")
    pts = {"left_shoulder": lmk["ls"], "right_shoulder": lmk["rs"],
           "left_ear": lmk["le"], "right_ear": lmk["re"], "c7": midpoint(lmk["ls"], lmk["rs"])}
    keys = (["user_id"] if by_user else []) + DAY_KEYS + ["posture_status"]
    values = {f"{p}_{a}": pts[p][a] for p in pts for a in AXES}
    aggs = [round_half_even(exact_mean(f"_{v}"), MEAN_DIGITS).alias(f"avg_{v}") for v in values]
    g = (facts.filter(F.col("posture_status").isNotNull())
         .select(*keys, *[c.alias(f"_{v}") for v, c in values.items()])
         .groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("cnt"))
         .withColumnRenamed("posture_status", "posture_correct"))
    sid = surrogate_key(F.lit("daily"), *(["user_id"] if by_user else []), *DAY_KEYS,
                        "posture_correct")
    name = average_image_name(F.col("posture_correct"), *[F.col(k) for k in DAY_KEYS])
    return g.select(sid.alias("daily_stat_id"), *(["user_id"] if by_user else []), *DAY_KEYS,
                    *AVG_COLUMNS, "posture_correct", name.alias("img_filename"), "cnt")


def ingest_counts(messages: DataFrame, ts: str = "ts", tz: str = "Asia/Seoul") -> DataFrame:
    """Messages per local ingest day (``yyyyMMdd``), the archive folder key."""
    day = F.date_format(F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz), "yyyyMMdd")
    return messages.groupBy(day.alias("ingest_date")).agg(F.count(F.lit(1)).alias("n_messages"))
