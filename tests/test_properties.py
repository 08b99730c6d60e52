import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vertebra.operators import reports
from vertebra.schemas import TB_DAILY_STAT


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 10**6))
def test_score_bounds_and_python_parity(spark, c, i):
    r = spark.range(1).select(reports.score(F.lit(c), F.lit(i)).alias("s")).first().s
    assert 0.0 <= r <= 100.0
    if c + i == 0:
        assert r == 0.0
    else:
        import numpy as np
        assert r == round(np.float64(c / (c + i) * 100), 2)


@settings(max_examples=12, deadline=None)
@given(st.dates(min_value=dt.date(2000, 1, 8), max_value=dt.date(2099, 12, 31)))
def test_calendar_week_is_eight_dates(spark, end):
    days = [end - dt.timedelta(days=k) for k in range(-3, 12)]
    rows = [("id", d.year, d.month, d.day, *[0.0] * 15, True, "f", 1) for d in days]
    m = spark.createDataFrame(rows, TB_DAILY_STAT)
    got = m.filter(reports.week_predicate(end, "calendar")).select("year_id", "month_id", "day_id").collect()
    assert sorted(dt.date(*r) for r in got) == [end - dt.timedelta(days=k) for k in range(7, -1, -1)]
