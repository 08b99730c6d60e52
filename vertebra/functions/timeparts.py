"""Time parsing, time-zone shifts and calendar parts.

The session time zone is pinned to UTC; a timestamp column holds the UTC
instant and the local wall clock is derived with ``from_utc_timestamp``.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: message time format and the default zone of the producer
MESSAGE_TS_PATTERN = "yyyy-MM-dd HH:mm:ss.SSSSSS Z"
LOCAL_TS_PATTERN = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DAY_PATTERN = "yyyy-MM-dd"
DEFAULT_TZ = "Asia/Seoul"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_instant(ts: Column | str) -> Column:
    """Treat a timestamp (NTZ holding UTC wall clock, or LTZ) as a UTC instant."""
    return _c(ts).cast("timestamp")


def parse_message_ts(text: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSSSSS +hhmm`` -> instant; bad text -> NULL (no error)."""
    return F.try_to_timestamp(_c(text), F.lit(MESSAGE_TS_PATTERN))


def local_time(ts: Column | str, tz: str = DEFAULT_TZ) -> Column:
    """Wall clock in ``tz`` (correct because the session zone is UTC)."""
    return F.from_utc_timestamp(as_instant(ts), tz)


def utc_offset_text(ts: Column | str, tz: str = DEFAULT_TZ) -> Column:
    """``+hhmm`` offset of ``tz`` at the instant (pattern ``Z`` would print the session's)."""
    inst = as_instant(ts)
    secs = (F.unix_micros(F.from_utc_timestamp(inst, tz)) - F.unix_micros(inst)) / 1_000_000
    secs = secs.cast("long")
    mag = F.abs(secs)
    return F.format_string("%s%02d%02d", F.when(secs < 0, F.lit("-")).otherwise(F.lit("+")),
                           (mag / 3600).cast("int"), ((mag % 3600) / 60).cast("int"))


def message_ts_text(ts: Column | str, tz: str = DEFAULT_TZ) -> Column:
    """Render an instant the way the producer stamps messages (local clock + offset)."""
    return F.concat(F.date_format(local_time(ts, tz), LOCAL_TS_PATTERN), F.lit(" "),
                    utc_offset_text(ts, tz))


def iso_year(d: Column) -> Column:
    """Year of the ISO week: the year of that week's Thursday."""
    return F.year(F.date_add(d, F.lit(3) - F.weekday(d)))


def calendar_parts(df: DataFrame, ts: str = "ts", tz: str = DEFAULT_TZ,
                   prefix: str = "") -> DataFrame:
    """Add local calendar parts of ``ts``.

    ``week_id`` is the ISO week beside the calendar ``year_id`` (so 2024-12-30 is
    week 1 of year 2024); ``iso_year`` gives the year the week belongs to.
    """
    local = local_time(ts, tz)
    d = F.to_date(local)
    return df.withColumns({
        f"{prefix}year_id": F.year(d),
        f"{prefix}month_id": F.month(d),
        f"{prefix}day_id": F.dayofmonth(d),
        f"{prefix}week_id": F.weekofyear(d),
        f"{prefix}iso_year": iso_year(d),
        f"{prefix}month_value": F.date_format(d, "MMMM"),
        f"{prefix}day_value": F.date_format(d, DAY_PATTERN),
    })


def week_start(end: Column, days: int = 7) -> Column:
    """First date of the report window ending at ``end`` (inclusive of both ends)."""
    return F.date_sub(end, days)


# a zone's clock may be set back across midnight, and two releases of the zone
# rules may differ: the pushed range is this much wider on either side
RANGE_MARGIN = dt.timedelta(hours=3)
# fixed values: the zones furthest east and west of UTC
EASTMOST, WESTMOST = dt.timedelta(hours=14), dt.timedelta(hours=12)


def instant_range(ts: Column | str, first: dt.date, last: dt.date, tz: str | None = DEFAULT_TZ,
                  ntz: bool = False) -> Column:
    """Range of the raw instants of the local dates ``first`` to ``last``, as plain
    comparisons with literals, which a scan can push down.

    It holds every instant of those dates and a little more, so it goes *beside* the
    exact condition on the calendar parts, never in its place.  Without ``tz`` it holds
    the dates in any zone.  ``ntz``: the column is a TIMESTAMP_NTZ with the UTC wall clock
    (the literals then are too; a cast of the column would not be pushed down).
    """
    # dates by the first and last instants they can have; kept inside the years a literal can name
    start = dt.datetime.combine(max(first, dt.date(1, 1, 3)), dt.time())
    end = dt.datetime.combine(min(last, dt.date(9999, 12, 28)), dt.time()) + dt.timedelta(days=1)
    if tz is None:
        start, end = start - EASTMOST, end + WESTMOST
    else:
        zone, utc = zoneinfo.ZoneInfo(tz), dt.timezone.utc
        start = min(start.replace(tzinfo=zone, fold=f).astimezone(utc) for f in (0, 1)).replace(tzinfo=None) - RANGE_MARGIN
        end = max(end.replace(tzinfo=zone, fold=f).astimezone(utc) for f in (0, 1)).replace(tzinfo=None) + RANGE_MARGIN
    lit = (lambda t: F.expr(f"TIMESTAMP_NTZ'{t.isoformat(' ')}'")) if ntz else (lambda t: F.expr(f"TIMESTAMP'{t.isoformat(' ')} UTC'"))
    return (_c(ts) >= lit(start)) & (_c(ts) < lit(end))


def dates_between(first: dt.date, last: dt.date, year: str = "year_id", month: str = "month_id",
                  day: str = "day_id") -> Column:
    """Dates by their parts: one comparison of year, month and day per month of the
    range, so a table partitioned by any of them is pruned to the folders it needs."""
    found = F.lit(False)
    at = first.replace(day=1)
    while at <= last:
        after = (at + dt.timedelta(days=31)).replace(day=1)
        lo, hi = max(first, at), min(last, after - dt.timedelta(days=1))
        found = found | ((F.col(year) == at.year) & (F.col(month) == at.month) & F.col(day).between(lo.day, hi.day))
        at = after
    return found
