"""Star-schema loading: facts, image rows, dimensions, idempotent upserts, star join.

Ids are content hashes of (source key, timestamp text), so a retried task or a
replayed batch produces the same ids and the upserts below stay idempotent.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import image_size, surrogate_key
from ..functions.timeparts import DEFAULT_TZ, as_instant, calendar_parts, instant_range, message_ts_text

CALENDAR_DIMS = ("year", "month", "week", "day")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def frame_ids(key: Column | str, ts: Column | str, tz: str = DEFAULT_TZ) -> dict[str, Column]:
    """posture_id, img_id and img_filename of a frame from its key and instant."""
    ts_text = message_ts_text(ts, tz)
    return {
        "posture_id": surrogate_key(F.lit("posture"), key, ts_text),
        "img_id": surrogate_key(F.lit("image"), key, ts_text),
        "img_filename": F.concat(F.lit("image_"), surrogate_key(F.lit("file"), key, ts_text),
                                 F.lit(".jpg")),
    }


def to_facts(df: DataFrame, key: str = "event_id", ts: str = "ts", user: str = "user_id",
             tz: str = DEFAULT_TZ, keep_landmarks: bool = True,
             extra: list[Column] | None = None) -> DataFrame:
    """Analysed frames -> ``tb_posture`` rows (+ ``landmarks`` for the daily mart, and
    ``extra`` columns, which may use the calendar parts).

    ``timestamp`` stays a real TIMESTAMP (UTC instant); text is rendered at the edge.
    """
    ids = frame_ids(key, ts, tz)
    df = calendar_parts(df, ts, tz)
    cols = [ids["posture_id"].alias("posture_id"), ids["img_filename"].alias("img_filename"),
            F.col(user).cast("string").alias("user_id"),
            F.col("cva_left").alias("cva_left_value"), F.col("cva_right").alias("cva_right_value"),
            F.col("fha_left").alias("fha_left_value"), F.col("fha_right").alias("fha_right_value"),
            F.col("posture_correct").alias("posture_status"),
            "day_id", "week_id", "month_id", "year_id", as_instant(ts).alias("timestamp")]
    if keep_landmarks:
        cols.append("landmarks")
    return df.select(*cols, *(extra or []))


def to_images(df: DataFrame, key: str = "event_id", ts: str = "ts", image: str = "image",
              tz: str = DEFAULT_TZ, keep_bytes: bool = False) -> DataFrame:
    """Frames with decoded image bytes -> ``tb_image`` rows (``image`` bytes optional)."""
    ids = frame_ids(key, ts, tz)
    cols = [ids["img_id"].alias("img_id"), ids["img_filename"].alias("img_filename"),
            as_instant(ts).alias("capture_time"), image_size(image).alias("file_size")]
    if keep_bytes:
        cols.append(F.col(image).alias("image"))
    return df.select(*cols)


def user_dim(facts: DataFrame) -> DataFrame:
    """One row per user seen in the facts; no personal attributes are invented."""
    return (facts.select("user_id").distinct()
            .select("user_id", F.concat(F.lit("user_"), "user_id").alias("user_name"),
                    F.lit(None).cast("int").alias("user_age"),
                    F.lit(None).cast("string").alias("user_gender")))


def calendar_dims(facts: DataFrame, tz: str = DEFAULT_TZ, materialize: bool = False
                  ) -> dict[str, DataFrame]:
    """Year, month, week and day dimensions, one row per key (distinct = partial agg).

    All four derive from one distinct (year, month, day, week) set, bounded by
    the number of calendar days the data spans.  Catalyst folds a distinct of a
    distinct into one aggregate over the facts, so each dimension would scan the
    facts again; ``materialize`` checkpoints the small day set once (shared
    checkpoint folder) and derives the four dimensions from it.
    """
    # a dimension row needs its key; stating that here also keeps plans that
    # join this set against itself free of one-sided inferred filters
    keyed = F.col("year_id").isNotNull() & F.col("month_id").isNotNull() & F.col("day_id").isNotNull()
    days = facts.filter(keyed).select("year_id", "month_id", "day_id", "week_id").distinct()
    if materialize:
        from ..session import cut_lineage
        days = cut_lineage(days)
    days = days.withColumn("_d", F.make_date("year_id", "month_id", "day_id"))
    return {
        "year": days.select("year_id", F.col("year_id").alias("year_value")).distinct(),
        "month": days.select("month_id", F.date_format("_d", "MMMM").alias("month_value"),
                             "year_id").distinct(),
        "week": days.select("week_id", F.col("week_id").alias("week_value"), "year_id").distinct(),
        "day": days.select("day_id", F.date_format("_d", "yyyy-MM-dd").alias("day_value"),
                           "month_id", "week_id", "year_id"),
    }


def to_dims(facts: DataFrame, tz: str = DEFAULT_TZ, materialize: bool = False
            ) -> dict[str, DataFrame]:
    dims = calendar_dims(facts, tz, materialize)
    dims["user"] = user_dim(facts)
    return dims


DIM_KEYS = {"year": ["year_id"], "month": ["year_id", "month_id"],
            "week": ["year_id", "week_id"], "day": ["year_id", "month_id", "day_id"],
            "user": ["user_id"], "image": ["img_filename"]}


def anti_join(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored; NULL equals NULL."""
    there = stored.select(*[F.col(k).alias(f"_stored_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & new[k].eqNullSafe(there[f"_stored_{k}"])
    return new.join(there, same, "left_anti")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """NULL-safe equality of ``keys`` of two frames that do not derive from each other."""
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(right[k])
    return same


def upsert_dim(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is new, once each (anti-join + dedup).

    Append the result to the stored dimension; running it twice adds nothing.
    """
    fresh = incoming.dropDuplicates(keys)
    return anti_join(fresh, existing, keys)


def merged_dim(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The dimension after the upsert, with ``inserted`` marking the new keys."""
    new = upsert_dim(existing, incoming, keys).withColumn("inserted", F.lit(True))
    return existing.withColumn("inserted", F.lit(False)).unionByName(new)


def star(facts: DataFrame, dims: dict[str, DataFrame], images: DataFrame | None = None
         ) -> DataFrame:
    """Fact rows with their dimension attributes on composite keys.

    No join is forced: the planner broadcasts a dimension only if its measured
    size allows it (AQE decides at run time).
    """
    out = facts
    for name in CALENDAR_DIMS:
        if name in dims:
            d = dims[name]
            out = out.join(d.select(*DIM_KEYS[name], *[c for c in d.columns if c not in DIM_KEYS[name]
                                                       and c not in out.columns]),
                           DIM_KEYS[name], "left")
    if "user" in dims:
        u = dims["user"]
        out = out.join(u, "user_id", "left")
    if images is not None:
        out = out.join(images.select("img_filename", "img_id", "capture_time", "file_size"),
                       "img_filename", "left")
    return out


def star_frames(df: DataFrame, key: str = "event_id", ts: str = "ts", user: str = "user_id",
                image: str = "image", tz: str = DEFAULT_TZ) -> DataFrame:
    """``star`` of frames whose dimensions derive from them: the same rows, in the scan
    that makes the facts, without a distinct, a join back or a written table.

    The calendar attributes, the name of a user without a stored row and the image's id,
    time and size are functions of the frame itself.  Dimensions that hold more than that
    (a users table with personal attributes) are stored tables: ``star`` joins them.
    """
    name = F.concat(F.lit("user_"), F.col(user).cast("string"))
    return to_facts(df, key, ts, user, tz, keep_landmarks="landmarks" in df.columns, extra=[
        F.col("year_id").alias("year_value"), F.col("month_value"), F.col("week_id").alias("week_value"), F.col("day_value"),
        name.alias("user_name"), F.lit(None).cast("int").alias("user_age"), F.lit(None).cast("string").alias("user_gender"),
        frame_ids(key, ts, tz)["img_id"].alias("img_id"), as_instant(ts).alias("capture_time"),
        image_size(image).alias("file_size")])


def with_user(df: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """User attributes from the user dimension (left join; the dimension grows
    with the data, so the planner's size check decides whether to broadcast)."""
    return df.join(users, key, "left")


def attach_images(facts: DataFrame, images: DataFrame) -> DataFrame:
    """Fact rows with their image bytes (equi-join on ``img_filename``)."""
    return facts.join(images, "img_filename", "inner")


def day_images(facts: DataFrame, images: DataFrame, year: int, month: int, day: int,
               posture: bool | None = None) -> DataFrame:
    """``day_class`` with the image bytes, from the stored image table: the scan reads the
    folder of the month and, by the statistics on ``capture_time``, the row groups of the
    day, so the bytes of other days stay where they are.  A frame without a stored image is
    left out; so is an image without a pose."""
    day_ = dt.date(year, month, day)
    stored = images.filter((F.col("year_id") == year) & (F.col("month_id") == month)
                           & instant_range("capture_time", day_, day_, tz=None))
    return attach_images(day_class(facts, year, month, day, posture), stored.select("img_filename", "image", "file_size"))


def day_class(facts: DataFrame, year: int, month: int, day: int,
              posture: bool | None = None) -> DataFrame:
    """File names and class of one day's frames with a pose, in one filtered scan.

    Beside the calendar parts, stored facts are cut by their instant (the day in any
    zone), which the scan holds against the statistics of its row groups."""
    f = facts
    if "timestamp" in facts.columns:
        day_ = dt.date(year, month, day)
        f = f.filter(instant_range("timestamp", day_, day_, tz=None))
    f = f.filter((F.col("year_id") == year) & (F.col("month_id") == month)
                     & (F.col("day_id") == day) & F.col("posture_status").isNotNull())
    if posture is not None:
        f = f.filter(F.col("posture_status") == F.lit(posture))
    return f.select("img_filename", "posture_status")
