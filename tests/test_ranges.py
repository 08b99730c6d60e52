"""Calendar parts translated to ranges a scan can push down: what is read, and that no date's edge is lost."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vertebra.functions.timeparts import calendar_parts, dates_between, instant_range
from vertebra.operators import reports, warehouse
from vertebra.plans import catalog
from vertebra.sinks import writers

SF = "/root/testdata/sf0.001"


def scans(df):
    return [ln for ln in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in ln]


@pytest.mark.parametrize("query", ["q_day_class_scan", "q_daily_report", "q_weekly_score", "q_weekly_score_literal",
                                   "q_weekly_landmarks", "q_weekly_landmarks_literal", "q_calendar_days", "q_calendar_map"])
def test_reports_push_their_dates_to_the_scan(spark, query):
    scan = [ln for ln in scans(catalog.QUERIES[query](spark, SF)) if "ts:timestamp_ntz" in ln]
    assert scan
    for ln in scan:
        pushed = ln.split("PushedFilters: [")[1]
        assert "GreaterThanOrEqual(ts," in pushed and "LessThan(ts," in pushed


@pytest.mark.parametrize("tz", ["Asia/Seoul", "UTC", "America/New_York", "America/Sao_Paulo", "Pacific/Kiritimati", "Pacific/Apia", "Etc/GMT+12"])
@pytest.mark.parametrize("first,last", [("2024-01-02", "2024-01-02"), ("2023-12-28", "2024-01-04"), ("2024-02-28", "2024-03-10"),
                                        ("2018-11-04", "2018-11-04"), ("2018-02-17", "2018-02-18"), ("2011-12-29", "2011-12-31"), ("2024-11-03", "2024-11-03")])
def test_range_holds_every_instant_of_its_dates(spark, tz, first, last):
    """Every 10 minutes around the dates, and a microsecond to both sides of each hour."""
    a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    lo, n = int(dt.datetime(a.year, a.month, a.day, tzinfo=dt.timezone.utc).timestamp()) - 3 * 86400, ((b - a).days + 7) * 144
    us = F.lit(lo * 1_000_000) + F.col("id") * 600_000_000
    ts = spark.range(n).select(F.explode(F.array(us - 1, us, us + 1)).alias("us")).select(F.timestamp_micros("us").alias("ts"))
    parts = calendar_parts(ts, "ts", tz).withColumn("n", F.col("ts").cast("timestamp_ntz"))
    exact = dates_between(a, b)
    whole = F.make_date("year_id", "month_id", "day_id").between(F.lit(a), F.lit(b))
    got = parts.agg(F.count_if(exact != whole), F.count_if(exact & ~instant_range("ts", a, b, tz)), F.count_if(exact & ~instant_range("n", a, b, tz, ntz=True)),
                    F.count_if(exact & ~instant_range("ts", a, b, None)), F.count_if(exact), F.count_if(instant_range("ts", a, b, tz))).first()
    assert got[:4] == (0, 0, 0, 0)
    assert got[4] <= got[5] <= got[4] + 3 * 6 * 9 + (3 * 144 if tz == "Pacific/Apia" else 0)  # and little more


def test_stored_tables_are_pruned(spark, tmp):
    f = catalog.facts(spark, SF)
    writers.write_facts(f, f"{tmp}/tb_posture")
    stored = spark.read.parquet(f"{tmp}/tb_posture")
    d = catalog.REPORT_DAY
    day = warehouse.day_class(stored, d.year, d.month, d.day)
    ln = scans(day)[0]
    assert "GreaterThanOrEqual(timestamp," in ln.split("PushedFilters: [")[1] and "month_id" in ln.split("PartitionFilters: [")[1]
    want = warehouse.day_class(f, d.year, d.month, d.day)
    assert sorted(map(tuple, day.collect())) == sorted(map(tuple, want.collect()))
    writers.write_daily_stat(catalog.mart(spark, SF), f"{tmp}/mart")
    week = reports.weekly_score(spark.read.parquet(f"{tmp}/mart"), dt.date(2024, 1, 31))
    held = scans(week)[0].split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert all(c in held for c in ("year_id", "month_id", "day_id"))
    assert week.collect() == catalog.QUERIES["q_weekly_score"](spark, SF).collect()


def test_week_over_the_turn_of_the_year(spark):
    rows = [(y, m, d, True, 1) for y, m, d in ((2023, 12, 27), (2023, 12, 28), (2023, 12, 31), (2024, 1, 1), (2024, 1, 4), (2024, 1, 5), (2024, 12, 30), (2023, 1, 2))]
    mart = spark.createDataFrame(rows, "year_id int, month_id int, day_id int, posture_correct boolean, cnt long")
    assert reports.weekly_score(mart, "2024-01-04").first().correct_cnt == 4


def test_an_impossible_date_is_in_no_week(spark):
    mart = spark.createDataFrame([(2024, 2, 30, True, 1), (2024, None, 3, True, 1), (2024, 2, 28, True, 1)], "year_id int, month_id int, day_id int, posture_correct boolean, cnt long")
    assert reports.weekly_score(mart, "2024-03-02").first().correct_cnt == 1
