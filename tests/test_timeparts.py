import datetime as dt


from vertebra.functions.timeparts import calendar_parts, message_ts_text, parse_message_ts


def test_iso_week_at_year_end(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 30, 3, 0),), (dt.datetime(2021, 1, 3, 3, 0),)],
                               "ts timestamp_ntz")
    rows = calendar_parts(df, "ts", "UTC").orderBy("ts").collect()
    assert (rows[0].week_id, rows[0].year_id, rows[0].iso_year) == (53, 2021, 2020)
    assert (rows[1].week_id, rows[1].year_id, rows[1].iso_year) == (1, 2024, 2025)


def test_kst_midnight(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 8, 21, 15, 0),)], "ts timestamp_ntz")
    r = calendar_parts(df, "ts").collect()[0]
    assert r.day_value == "2024-08-22" and r.month_value == "August"


def test_message_text_round_trip_and_bad_text(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 7, 179575),)], "ts timestamp_ntz")
    r = df.select(message_ts_text("ts").alias("t")).collect()[0]
    assert r.t == "2024-01-01 09:00:07.179575 +0900"
    back = spark.createDataFrame([(r.t,), ("bad",)], "t string").select(
        parse_message_ts("t").cast("timestamp_ntz").alias("ts")).collect()
    assert back[0].ts == dt.datetime(2024, 1, 1, 0, 0, 7, 179575)
    assert back[1].ts is None
