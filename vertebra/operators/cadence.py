"""Capture cadence: gaps between a user's consecutive frames (extension, T7).

The producer sends a frame every 600 ms; longer gaps show lag or drops.
The previous frame is found without a window over a whole user: ``lag`` works
inside range blocks of (user, instant), and the first frame of a block takes the
last instant of the user's blocks before from one summary row per (user, block).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeparts import DEFAULT_TZ, local_time
from .blocks import BLOCK, carried, fixed_blocks, inside
from .status import USER, user_back, user_keys

# fixed value: capture cadence of the live client (milliseconds)
CADENCE_MS = 600


def with_prev_ts(df: DataFrame, user: str = "user_id", ts: str = "ts", tiebreak: str = "event_id",
                 blocks: int | None = None) -> DataFrame:
    """``user, tiebreak, _us, prev_us``: epoch micro-seconds of each frame and of
    the user's previous frame in (ts, tiebreak) order."""
    dtype = dict(df.dtypes)[user]
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    d = user_keys(df.select(user, us.alias("_us"), tiebreak), user).drop(user)
    d = fixed_blocks(d, [*USER, "_us", tiebreak], blocks)
    d = d.withColumn("_prev_in", F.lag("_us").over(inside(USER, ["_us", tiebreak])))
    # the summary reads the windowed rows (greatest(_us, _prev_in) = _us), so
    # both branches carry the same columns and share one shuffle
    seg = d.groupBy(*USER, BLOCK).agg(F.max(F.greatest("_us", "_prev_in")).alias("_seg_max"))
    seg = seg.select(*USER, BLOCK, carried(USER, F.col("_seg_max")).alias("_prev_seg"))
    return (d.join(seg, [*USER, BLOCK], "left")
             .select(user_back(user, dtype), tiebreak, "_us",
                     F.coalesce("_prev_in", "_prev_seg").alias("prev_us")))


def capture_gaps(df: DataFrame, user: str = "user_id", ts: str = "ts", tiebreak: str = "event_id",
                 tz: str = DEFAULT_TZ, cadence_ms: int = CADENCE_MS) -> DataFrame:
    """Per user and local day: frames, gaps, largest and mean gap (s), and gaps
    longer than twice the cadence.  A gap belongs to the day of its later frame."""
    d = with_prev_ts(df, user, ts, tiebreak)
    gap = (F.col("_us") - F.col("prev_us"))
    day = F.date_format(local_time(F.timestamp_micros("_us"), tz), "yyyy-MM-dd")
    d = d.select(user, day.alias("day_value"), gap.alias("_gap"))
    g = d.groupBy(user, "day_value").agg(
        F.count(F.lit(1)).alias("n_frames"), F.count("_gap").alias("n_gaps"),
        F.max("_gap").alias("_max"), F.sum("_gap").alias("_sum"),
        F.count(F.when(F.col("_gap") > 2 * cadence_ms * 1000, 1)).alias("n_slow"))
    return g.select(user, "day_value", "n_frames", "n_gaps",
                    (F.col("_max") / F.lit(1e6)).alias("max_gap_s"),
                    (F.col("_sum").cast("double") / (F.col("n_gaps").cast("double") * F.lit(1e6)))
                    .alias("mean_gap_s"), "n_slow")
