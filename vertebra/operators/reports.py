"""Report queries over the daily mart: calendar, daily and weekly scores,
weekly mean landmarks, month grid and chart segments.

Every report is a filter + aggregation plan; parameters are typed values,
never SQL text.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_mean_fixed, round_half_even
from ..functions.timeparts import dates_between
from ..schemas import AVG_COLUMNS, POINT_NAMES
from .mart import MEAN_DIGITS

SCORE_DIGITS = 2
WEEK_DAYS = 7
# fixed value: chart axis margin as a share of the y range
AXIS_MARGIN = 0.6


def _date(d) -> _dt.date:
    return d if isinstance(d, _dt.date) else _dt.date.fromisoformat(str(d))


def score(correct: Column, incorrect: Column) -> Column:
    """``correct / total * 100`` to 2 decimals; 0 when there is nothing to score."""
    total = correct + incorrect
    return (F.when(total == 0, F.lit(0.0))
            .otherwise(round_half_even(correct.cast("double") / total * 100, SCORE_DIGITS)))


def _class_counts(pc: Column, cnt: Column) -> tuple[Column, Column]:
    correct = F.coalesce(F.sum(F.when(pc, cnt)), F.lit(0)).cast("long")
    # a NULL class counts as incorrect
    incorrect = F.coalesce(F.sum(F.when(~F.coalesce(pc, F.lit(False)), cnt)), F.lit(0)).cast("long")
    return correct, incorrect


# ---- calendar --------------------------------------------------------------

def calendar_days(mart: DataFrame, year: int | None = None) -> DataFrame:
    """Distinct (month, day) with data, for one year or all years.

    Only full dates count; stating that filter here also keeps the branches
    that reuse this set identical (no join-inferred filter on one side only).
    """
    m = mart if year is None else mart.filter(F.col("year_id") == year)
    m = m.filter(F.col("year_id").isNotNull() & F.col("month_id").isNotNull()
                 & F.col("day_id").isNotNull())
    return m.select("year_id", "month_id", "day_id").distinct()


def calendar_map(mart: DataFrame, year: int | None = None) -> DataFrame:
    """One row per month: sorted day list (the month -> days map, row form)."""
    d = calendar_days(mart, year)
    return d.groupBy("year_id", "month_id").agg(F.sort_array(F.collect_set("day_id")).alias("days"))


def calendar_map_value(mart: DataFrame, year: int) -> DataFrame:
    """API form: one row holding ``map<month, array<day>>`` (at most 12 entries)."""
    m = calendar_map(mart, year)
    return m.agg(F.map_from_entries(F.collect_list(F.struct("month_id", "days"))).alias("data_by_month"))


def calendar_grid(mart: DataFrame, today: _dt.date | str, year: int | None = None,
                  month: int | None = None) -> DataFrame:
    """Day cells of every month with data (or of one month), with weekday, weekend,
    today and has-data flags (and, for months with data, ``days_with_data``).
    ``weekday`` is 0 = Sunday .. 6 = Saturday.

    A year alone gives that year's months with data.  Both sides hold at most one row per
    calendar day spanned; the planner picks the join by their measured size.
    """
    t = _date(today)
    days = calendar_days(mart)
    if year is not None and month is not None:
        months = mart.sparkSession.range(1).select(F.lit(year).alias("year_id"),
                                                   F.lit(month).alias("month_id"))
    else:
        # a counting aggregate (not a bare distinct) keeps Catalyst from folding
        # it into a second pass over the mart: both branches share the day set
        months = days.groupBy("year_id", "month_id").agg(F.count(F.lit(1)).alias("days_with_data"))
        if year is not None:
            months = months.filter(F.col("year_id") == year)
    first = F.make_date("year_id", "month_id", F.lit(1))
    extra = ["days_with_data"] if "days_with_data" in months.columns else []
    grid = (months.select("year_id", "month_id", *extra,
                          F.explode(F.sequence(first, F.last_day(first))).alias("_d"))
            .select("year_id", "month_id", *extra, F.dayofmonth("_d").alias("day_id"),
                    (F.dayofweek("_d") - 1).alias("weekday"),
                    ((F.dayofmonth("_d") + F.dayofweek(first) - 2) / 7).cast("int").alias("week_row")))
    flags = days.select("year_id", "month_id", "day_id", F.lit(True).alias("_has"))
    return (grid.join(flags, ["year_id", "month_id", "day_id"], "left")
            .select("year_id", "month_id", "day_id", *extra, "weekday", "week_row",
                    (F.col("weekday") == 0).alias("is_sunday"),
                    (F.col("weekday") == 6).alias("is_saturday"),
                    ((F.col("year_id") == t.year) & (F.col("month_id") == t.month)
                     & (F.col("day_id") == t.day)).alias("is_today"),
                    F.coalesce("_has", F.lit(False)).alias("has_data")))


# ---- daily -----------------------------------------------------------------

def daily_scores(mart: DataFrame) -> DataFrame:
    """Per day: class counts, class image names and score (pivot of the two rows)."""
    pc, cnt = F.col("posture_correct"), F.col("cnt")
    correct, incorrect = _class_counts(pc, cnt)
    g = mart.groupBy("year_id", "month_id", "day_id").agg(
        correct.alias("correct_cnt"), incorrect.alias("incorrect_cnt"),
        F.max(F.when(pc, F.col("img_filename"))).alias("correct_img_filename"),
        F.max(F.when(~F.coalesce(pc, F.lit(False)), F.col("img_filename"))).alias("incorrect_img_filename"))
    return g.withColumn("score", score(F.col("correct_cnt"), F.col("incorrect_cnt")))


def daily_report(mart: DataFrame, day: _dt.date | str) -> DataFrame:
    """Score and class image names of one day; no row when the day has no data."""
    d = _date(day)
    m = mart.filter((F.col("year_id") == d.year) & (F.col("month_id") == d.month)
                    & (F.col("day_id") == d.day))
    return daily_scores(m)


# ---- weekly ----------------------------------------------------------------

def _literal_parts(s: _dt.date, e: _dt.date) -> tuple[Column, Column]:
    """What the original report's date-part rule selects: the rest of the start month, and
    apart from it (the class filter binds to the first part only) the start year after
    that month or the end year up to the end date."""
    year, date = F.col("year_id"), F.make_date("year_id", "month_id", "day_id")
    month_end = F.last_day(F.lit(s))
    return ((year == s.year) & date.between(F.lit(s), month_end),
            ((year == s.year) & (date > month_end)) | ((year == e.year) & (date <= F.lit(e))))


def week_predicate(end: _dt.date | str, mode: str = "calendar", days: int = WEEK_DAYS) -> Column:
    """Rows of the report window ending at ``end``.

    ``calendar``: the dates ``end - days .. end`` (both ends, so 8 dates), by
    their parts, so a mart partitioned by year, month and day reads just their
    folders.  ``literal``: the rows that the original report's rule over date
    parts selects, which within one calendar year are far more than a week; a
    row without a full date is in neither.
    """
    e = _date(end)
    s = e - _dt.timedelta(days=days)
    if mode == "calendar":
        return dates_between(s, e)
    if mode == "literal":
        head, rest = _literal_parts(s, e)
        return head | rest
    raise ValueError(f"unknown mode {mode!r}")


def weekly_score(mart: DataFrame, end: _dt.date | str, mode: str = "calendar") -> DataFrame:
    """Counts summed over the window and their score; always exactly one row."""
    pc, cnt = F.col("posture_correct"), F.col("cnt")
    correct, incorrect = _class_counts(pc, cnt)
    g = mart.filter(week_predicate(end, mode)).agg(correct.alias("correct_cnt"),
                                                   incorrect.alias("incorrect_cnt"))
    return g.withColumn("score", score(F.col("correct_cnt"), F.col("incorrect_cnt")))


def weekly_landmarks(mart: DataFrame, end: _dt.date | str, mode: str = "calendar") -> DataFrame:
    """Unweighted mean of the daily means per class: two rows (True, False) always.

    One scan with conditional aggregates (no second scan, no join); a class
    without rows gets NULL means.  ``literal`` reproduces the original
    precedence: ``class AND first-branch OR other branches``.
    """
    e = _date(end)
    s = e - _dt.timedelta(days=WEEK_DAYS)
    pc = F.col("posture_correct")
    preds = {}
    for label, cls in (("t", True), ("f", False)):
        if mode == "calendar":
            preds[f"_in_{label}"] = (pc == F.lit(cls)) & week_predicate(e, "calendar")
        elif mode == "literal":
            head, rest = _literal_parts(s, e)
            preds[f"_in_{label}"] = ((pc == F.lit(cls)) & head) | rest
        else:
            raise ValueError(f"unknown mode {mode!r}")
    # rows outside the window feed neither class: filter first (partition
    # pruning on a stored mart), then evaluate each class predicate once per
    # row and share it across its 15 aggregates
    m = (mart.filter(week_predicate(e, mode))
         .select(*AVG_COLUMNS, *[p.alias(k) for k, p in preds.items()]))
    aggs = [exact_mean_fixed(F.when(F.col(f"_in_{label}"), F.col(c)), MEAN_DIGITS).alias(f"{label}__{c}")
            for label in ("t", "f") for c in AVG_COLUMNS]
    wide = m.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(cls).alias("posture_correct"),
                              *[F.col(f"{label}__{c}").alias(c) for c in AVG_COLUMNS])
                     for label, cls in (("t", True), ("f", False))])
    return wide.select(F.inline(rows))


# ---- charts and rollups ----------------------------------------------------

def skeleton_segments(mart: DataFrame, negate_y: bool = False) -> DataFrame:
    """Chart data: one row per (day, class, body point) with the C7 end of its
    segment and the y-axis bounds (min/max y of the five points +- 60 % of range).

    Works on any frame with the 15 mean columns: mart rows (daily charts) or
    ``weekly_landmarks`` rows (the weekly chart, drawn with ``negate_y``).
    """
    keys = [c for c in ("daily_stat_id", "year_id", "month_id", "day_id", "posture_correct")
            if c in mart.columns]
    sgn = -1.0 if negate_y else 1.0
    ys = [F.col(f"avg_{p}_y") * sgn for p in POINT_NAMES]
    lo, hi = F.least(*ys), F.greatest(*ys)
    rng = hi - lo
    pts = F.array(*[F.struct(F.lit(p).alias("point"), F.col(f"avg_{p}_x").alias("x"),
                             (F.col(f"avg_{p}_y") * sgn).alias("y"), F.col(f"avg_{p}_z").alias("z"))
                    for p in POINT_NAMES[:-1]])
    return (mart.select(*keys,
                        F.col("avg_c7_x").alias("c7_x"), (F.col("avg_c7_y") * sgn).alias("c7_y"),
                        F.col("avg_c7_z").alias("c7_z"),
                        (lo - rng * AXIS_MARGIN).alias("y_lo"), (hi + rng * AXIS_MARGIN).alias("y_hi"),
                        F.inline(pts))
            .select(*keys, "point", "x", "y", "z", "c7_x", "c7_y", "c7_z", "y_lo", "y_hi"))


def score_rollup(mart: DataFrame) -> DataFrame:
    """Scores at day, month, year and overall level (rollup; extension)."""
    pc, cnt = F.col("posture_correct"), F.col("cnt")
    correct, incorrect = _class_counts(pc, cnt)
    g = mart.rollup("year_id", "month_id", "day_id").agg(
        correct.alias("correct_cnt"), incorrect.alias("incorrect_cnt"),
        F.grouping_id().cast("int").alias("level"))
    return g.withColumn("score", score(F.col("correct_cnt"), F.col("incorrect_cnt")))
