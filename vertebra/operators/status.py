"""Live status: label per result, label carried over frames without a pose,
and the newest result per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK, carried, fixed_blocks, inside

# fixed values: the two status messages of the live screen
GOOD_LABEL = "옳은 자세입니다"
BAD_LABEL = "자세를 바르게 해주세요"

# non-nullable form of the user: (is NULL, user or a default)
USER = ["_unull", "_ukey"]


def status_label(posture: Column | str, good: str = GOOD_LABEL, bad: str = BAD_LABEL) -> Column:
    """True -> good label, False -> bad label, NULL (no pose) -> NULL (no change)."""
    p = F.col(posture) if isinstance(posture, str) else posture
    return F.when(p == F.lit(True), F.lit(good)).when(p == F.lit(False), F.lit(bad))


def user_keys(df: DataFrame, user: str) -> DataFrame:
    """``df`` with the user as ``USER``.

    Non-nullable keys keep Catalyst from inferring ``IsNotNull`` filters on one
    branch of the join back, which would make the two branches differ and
    defeat the reuse of their shared shuffle.  NULL users stay one group.
    """
    dt = dict(df.dtypes)[user]
    default = F.lit("") if dt == "string" else F.lit(0).cast(dt)
    return df.withColumns({"_unull": F.col(user).isNull(), "_ukey": F.coalesce(F.col(user), default)})


def user_back(user: str, dtype: str) -> Column:
    return F.when(F.col("_unull"), F.lit(None).cast(dtype)).otherwise(F.col("_ukey")).alias(user)


def status_carry(df: DataFrame, label: str = "status_label", user: str = "user_id",
                 ts: str = "ts", tiebreak: str = "event_id", out: str = "status",
                 blocks: int | None = None) -> DataFrame:
    """``user, ts, tiebreak, out``: the last non-NULL label so far per user, in
    (ts, tiebreak) order (join back on ``tiebreak`` for other columns).

    A window over the whole user would put a heavy user in one task; instead
    the frames are cut into range blocks of (user, ts, tiebreak), which split a
    heavy user and also a heavy instant: a window inside each (user, block),
    then a carry across one small summary row per (user, block).  The narrow rows
    are written once with their block, so both passes see the same blocks and
    the input is not read again.
    """
    dtype = dict(df.dtypes)[user]
    d = user_keys(df.select(user, ts, tiebreak, label), user).drop(user)
    d = fixed_blocks(d, [*USER, ts, tiebreak], blocks)
    so_far = inside(USER, [ts, tiebreak]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_local", F.last(label, ignorenulls=True).over(so_far))
    # the summary is read off the windowed rows: they are already partitioned
    # by (user, block) and sorted, so the summary needs no shuffle
    seg = d.groupBy(*USER, BLOCK).agg(
        F.max_by("_local", F.struct(F.col(ts), F.col(tiebreak))).alias("_seg_last"))
    seg = seg.select(*USER, BLOCK, carried(USER, F.col("_seg_last")).alias("_carry_in"))
    return (d.join(seg, [*USER, BLOCK], "left")
             .select(user_back(user, dtype), ts, tiebreak,
                     F.coalesce("_local", "_carry_in").alias(out)))


def live_status(df: DataFrame, user: str = "user_id", ts: str = "ts", tiebreak: str = "event_id",
                label: str = "status_label",
                fields: tuple[str, ...] = ("cva_left", "cva_right", "fha_left", "fha_right",
                                           "posture_correct")) -> DataFrame:
    """Newest result per user; its NULL angles replace older values, while the
    label stays the newest non-NULL one.  A single aggregation with partial
    aggregation, so a heavy user costs one partial row per task."""
    order = F.struct(F.col(ts), F.col(tiebreak))
    latest = F.max_by(F.struct(F.col(ts).alias("ts"), F.col(tiebreak).alias(tiebreak),
                               *[F.col(c) for c in fields]), order)
    lab = F.max_by(F.col(label), F.when(F.col(label).isNotNull(), order))
    return (df.groupBy(user).agg(latest.alias("_l"), lab.alias("status"))
              .select(user, "_l.*", "status"))
