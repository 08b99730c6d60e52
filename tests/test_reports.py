import datetime as dt

import pytest

from vertebra.operators import reports
from vertebra.plans import catalog
from vertebra.schemas import TB_DAILY_STAT


@pytest.fixture(scope="module")
def mart001(spark):
    return catalog.mart(spark, "/root/testdata/sf0.001").cache()


@pytest.fixture(scope="module")
def mart01(spark):
    return catalog.mart(spark, "/root/testdata/sf0.01").cache()


def test_daily_report_values(mart001, mart01):
    r = reports.daily_report(mart001, "2024-01-02").collect()[0]
    assert (r.correct_cnt, r.incorrect_cnt, r.score) == (27, 4, 87.1)
    r = reports.daily_report(mart01, "2024-01-02").collect()[0]
    assert (r.correct_cnt, r.incorrect_cnt, r.score) == (218, 66, 76.76)
    assert r.correct_img_filename == "average_correct_2024-1-2.png"


def test_weekly_scores(mart001, mart01):
    r = reports.weekly_score(mart001, "2024-01-31").collect()[0]
    assert (r.correct_cnt, r.incorrect_cnt, r.score) == (134, 48, 73.63)
    r = reports.weekly_score(mart01, "2024-01-31").collect()[0]
    assert (r.correct_cnt, r.incorrect_cnt, r.score) == (1530, 450, 77.27)
    assert reports.weekly_score(mart01, "2024-01-31", "literal").collect()[0].score == 76.73
    assert reports.weekly_score(mart001, "2024-01-31", "literal").collect()[0].score == 75.72


def test_weekly_landmarks(mart001, mart01):
    got = {r.posture_correct: r.avg_left_ear_x for r in
           reports.weekly_landmarks(mart01, "2024-01-31").collect()}
    assert got[True] == pytest.approx(-0.043875, abs=1e-12)
    assert got[False] == pytest.approx(0.0555, abs=1e-12)
    lit = {r.posture_correct: r.avg_left_ear_x for r in
           reports.weekly_landmarks(mart01, "2024-01-31", "literal").collect()}
    assert lit[True] == pytest.approx(0.006919, abs=1e-6)
    assert lit[False] == pytest.approx(0.006919, abs=1e-6)


def _mart(spark, rows):
    full = []
    for y, m, d, pc, cnt in rows:
        full.append(("id", y, m, d, *[0.1] * 15, pc, f"average_x_{y}-{m}-{d}.png", cnt))
    return spark.createDataFrame(full, TB_DAILY_STAT)


def test_day_with_one_class(spark):
    m = _mart(spark, [(2024, 3, 5, True, 7)])
    r = reports.daily_report(m, "2024-03-05").collect()[0]
    assert (r.correct_cnt, r.incorrect_cnt, r.incorrect_img_filename, r.score) == (7, 0, None, 100.0)
    assert reports.daily_report(m, "2024-03-06").count() == 0


def test_empty_week_one_row(spark):
    m = _mart(spark, [(2024, 3, 5, True, 7)])
    rows = reports.weekly_score(m, "2024-06-30").collect()
    assert len(rows) == 1 and rows[0].score == 0.0 and rows[0].correct_cnt == 0
    wl = reports.weekly_landmarks(m, "2024-06-30").collect()
    assert len(wl) == 2 and all(r.avg_c7_x is None for r in wl)


def test_week_over_year_end(spark):
    days = [dt.date(2023, 12, 20) + dt.timedelta(days=i) for i in range(20)]
    m = _mart(spark, [(d.year, d.month, d.day, True, 1) for d in days])
    r = reports.weekly_score(m, "2024-01-04").collect()[0]
    assert r.correct_cnt == 8  # 2023-12-28 .. 2024-01-04


def test_calendar_grid_and_map(spark, mart01):
    g = reports.calendar_grid(mart01, "2024-01-31").orderBy("day_id").collect()
    assert len(g) == 31 and g[0].weekday == 1  # 2024-01-01 is a Monday
    assert g[-1].is_today and all(r.has_data for r in g)
    mp = reports.calendar_map_value(mart01, 2024).collect()[0].data_by_month
    assert list(mp[1]) == list(range(1, 32))


def test_skeleton_segments_four_points(mart001):
    s = reports.skeleton_segments(mart001)
    assert s.count() == 4 * mart001.count()
    r = s.first()
    assert r.y_lo <= r.y <= r.y_hi


def test_reports_prune_stored_mart_partitions(spark, mart01, tmp):
    from vertebra.sinks import writers
    writers.write_daily_stat(mart01, f"{tmp}/mart")
    stored = spark.read.parquet(f"{tmp}/mart")
    for df in (reports.weekly_score(stored, "2024-01-31"),
               reports.weekly_landmarks(stored, "2024-01-31"),
               reports.daily_report(stored, "2024-01-02")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "year_id" in plan.split("PartitionFilters: [")[1][:400]
    assert reports.weekly_score(stored, "2024-01-31").first().score == 77.27


def test_calendar_grid_single_month_without_data(spark, mart01):
    g = reports.calendar_grid(mart01, "2024-02-10", year=2024, month=2).orderBy("day_id").collect()
    assert len(g) == 29 and not any(r.has_data for r in g)  # leap year February
    assert [r.is_today for r in g].index(True) == 9
    assert g[0].weekday == 4  # 2024-02-01 is a Thursday


def test_with_user_keeps_every_fact(spark):
    from vertebra.operators import warehouse
    f = catalog.facts(spark, "/root/testdata/sf0.001")
    u = warehouse.user_dim(f)
    j = warehouse.with_user(f, u)
    assert j.count() == f.count() and j.filter("user_name is null").count() == 0


def test_weekly_chart_segments(mart01):
    wl = reports.weekly_landmarks(mart01, "2024-01-31")
    seg = reports.skeleton_segments(wl, negate_y=True).collect()
    assert len(seg) == 8 and {r.point for r in seg} == {"left_shoulder", "right_shoulder", "left_ear", "right_ear"}
    r = seg[0]
    assert r.y_lo <= r.y <= r.y_hi and r.y_lo <= r.c7_y <= r.y_hi
