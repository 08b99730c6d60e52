import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vertebra.operators import status
from vertebra.operators.cadence import with_prev_ts
from vertebra.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    a = catalog.analyzed(spark, SF).withColumn("status_label", status.status_label("posture_correct"))
    return a.select("event_id", "user_id", "ts", "status_label", "cva_left", "cva_right",
                    "fha_left", "fha_right", "posture_correct").cache()


@pytest.mark.parametrize("blocks", [None, 1, 7, 60])
def test_carry_equals_whole_user_window(labelled, blocks):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    brute = labelled.select("event_id", F.last("status_label", True).over(w).alias("status"))
    got = status.status_carry(labelled, blocks=blocks).select("event_id", "status")
    assert got.count() == brute.count()
    assert got.exceptAll(brute).count() == 0


@pytest.mark.parametrize("blocks", [None, 1, 60])
def test_prev_ts_equals_lag(labelled, blocks):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    brute = labelled.select("event_id", F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w).alias("p"))
    got = with_prev_ts(labelled, blocks=blocks).select("event_id", F.col("prev_us").alias("p"))
    assert got.exceptAll(brute).count() == 0 and brute.exceptAll(got).count() == 0


def test_live_status_newest_row(labelled):
    live = status.live_status(labelled).collect()
    assert len(live) == labelled.select("user_id").distinct().count()
    r = live[0]
    newest = labelled.filter(F.col("user_id") == r.user_id).orderBy(F.desc("ts"), F.desc("event_id")).first()
    assert r.event_id == newest.event_id
