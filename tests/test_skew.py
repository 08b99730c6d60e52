"""One user holding a third of all frames: results stay exact, work stays split."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vertebra.operators import mart, status
from vertebra.operators.blocks import ranked, with_blocks
from vertebra.operators.cadence import capture_gaps, with_prev_ts
from vertebra.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def hot(spark):
    a = catalog.analyzed(spark, SF)
    a = a.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
    return a.withColumn("status_label", status.status_label("posture_correct")).cache()


def test_hot_user_is_a_third(hot):
    n, h = hot.count(), hot.filter("user_id = 0").count()
    assert h * 3 >= n - 3


def test_carry_exact_and_split(hot):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    brute = hot.select("event_id", F.last("status_label", True).over(w).alias("status"))
    got = status.status_carry(hot).select("event_id", "status")
    assert got.exceptAll(brute).count() == 0 and brute.exceptAll(got).count() == 0
    blocks = with_blocks(hot.select("user_id", "ts", "event_id"), ["user_id", "ts", "event_id"], 24)
    per = blocks.groupBy("_block").agg(F.count("*").alias("n"), F.count(F.when(F.col("user_id") == 0, 1)).alias("hot")).collect()
    assert sum(r.hot > 0 for r in per) >= 7 and max(r.n for r in per) < 3 * hot.count() / 24


def test_a_third_of_all_rows_in_one_instant(spark, hot):
    """One user, one instant: only the frame's id orders these rows, and still no block holds more than its share."""
    third = hot.withColumn("ts", F.when(F.col("user_id") == 0, F.lit("2024-01-05 10:00:00").cast(hot.schema["ts"].dataType)).otherwise(F.col("ts")))
    third = third.select("event_id", "user_id", "ts", "status_label").cache()
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n, us = third.count(), F.unix_micros(F.col("ts").cast("timestamp"))
    brute = third.select("event_id", F.last("status_label", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("status"))
    got = status.status_carry(third, blocks=24).select("event_id", "status")
    assert got.exceptAll(brute).count() == 0 and brute.exceptAll(got).count() == 0
    brute = third.select("event_id", F.lag(us).over(w).alias("p"))
    got = with_prev_ts(third, blocks=24).select("event_id", F.col("prev_us").alias("p"))
    assert got.exceptAll(brute).count() == 0 and brute.exceptAll(got).count() == 0
    per = [r.n for r in with_blocks(third, ["user_id", "ts", "event_id"], 24).filter("user_id = 0").groupBy("_block").agg(F.count("*").alias("n")).collect()]
    assert len(per) >= 7 and max(per) < 3 * n / 24


def test_ranks_over_blocks_equal_row_numbers(spark, hot, tmp):
    with_blocks(hot.select("user_id", "ts", "event_id"), ["user_id", "ts", "event_id"], 24).write.parquet(f"{tmp}/blocks")
    got = ranked(spark.read.parquet(f"{tmp}/blocks"), ["user_id"], ["ts", "event_id"], "r", "n").select("event_id", "r", "n")
    w = Window.partitionBy("user_id")
    brute = hot.select("event_id", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long").alias("r"), F.count("*").over(w).alias("n"))
    assert got.exceptAll(brute).count() == 0 and brute.exceptAll(got).count() == 0


def test_gaps_exact(hot):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    brute = hot.select("event_id", F.lag(us).over(w).alias("p"))
    got = with_prev_ts(hot).select("event_id", F.col("prev_us").alias("p"))
    assert got.exceptAll(brute).count() == 0 and brute.exceptAll(got).count() == 0
    g = capture_gaps(hot.select("event_id", "user_id", "ts")).filter("user_id = 0")
    assert g.agg(F.sum("n_frames")).first()[0] == hot.filter("user_id = 0").count()


def test_live_status_and_mart_by_user(hot):
    live = {r.user_id: r.event_id for r in status.live_status(hot).collect()}
    newest = hot.filter("user_id = 0").orderBy(F.desc("ts"), F.desc("event_id")).first()
    assert live[0] == newest.event_id
    facts = hot.select("event_id", "ts", "user_id", "landmarks", "cva_left", "cva_right", "fha_left",
                       "fha_right", "posture_correct")
    from vertebra.operators import warehouse
    m = mart.daily_stat(warehouse.to_facts(facts), by_user=True)
    assert m.filter("user_id = '0'").agg(F.sum("cnt")).first()[0] == \
        hot.filter("user_id = 0 and posture_correct is not null").count()
