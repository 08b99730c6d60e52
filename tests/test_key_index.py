"""The key index: what a batch reads and moves, and that no broken run loses or doubles a row."""

import pytest
from pyspark.sql import functions as F

from vertebra.operators import warehouse
from vertebra.plans import catalog
from vertebra.sinks import keys, writers

SF = "/root/testdata/sf0.001"
KEY = ["img_filename"]


@pytest.fixture(scope="module")
def images(spark):
    im = warehouse.to_images(catalog.decoded_images(spark, SF), "event_id", "ts", "image", keep_bytes=True)
    return im.cache()


def stored(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("img_filename", "image").collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_key_once_whatever_comes_again(spark, images, tmp):
    p = f"{tmp}/tb_image"
    early, late = images.filter("capture_time < '2024-01-10'"), images.filter("capture_time >= '2024-01-08'")
    writers.write_images(early.unionByName(early), p)
    writers.write_images(early, p)
    writers.write_images(late.unionByName(early.limit(40)), p)
    want = sorted(map(tuple, images.select("img_filename", "image").collect()))
    assert stored(spark, p) == want
    index = spark.read.parquet(keys.index_path(p))
    assert index.count() == len(want) == index.select(*KEY).distinct().count()
    assert spark.read.parquet(p).join(index, KEY).where(F.expr("_hour <> unix_seconds(capture_time) div 3600")).count() == 0


def test_a_batch_reads_its_own_hours_and_moves_keys_only(spark, images, tmp):
    p = f"{tmp}/tb_image"
    writers.write_images(images, p)
    images.write.parquet(f"{tmp}/arrived")
    hour = spark.read.parquet(f"{tmp}/arrived").filter("capture_time >= '2024-01-05 03:00:00' AND capture_time < '2024-01-05 05:00:00'")
    hours = sorted(r[0] for r in hour.select(keys.hour_of("capture_time")).distinct().collect())
    assert 1 <= len(hours) <= 2
    marked = keys.mark(hour, p, KEY, "capture_time")
    scans = [ln for ln in plan_of(marked).splitlines() if "FileScan" in ln]
    source, index = sorted(scans, key=lambda ln: "capture_time" not in ln)
    held = index.split("PartitionFilters: [")[1].split("]")[0]
    assert "_hour" in held and all(str(h) in held for h in hours)
    # the bytes are not even read for it
    assert "ReadSchema: struct<img_filename:string,capture_time:timestamp>" in source
    marked.write.parquet(f"{tmp}/marked")
    rows = keys.unstored(hour, spark.read.parquet(f"{tmp}/marked"), KEY)
    assert rows.count() == 0
    assert "BroadcastHashJoin" in plan_of(rows) and "SortMergeJoin" not in plan_of(rows)
    shuffles = [ln for ln in plan_of(rows).splitlines() if "Exchange" in ln and "BroadcastExchange" not in ln]
    assert shuffles == []


@pytest.mark.parametrize("limit", [0, 3, 10**6])
def test_rows_are_the_same_beyond_the_broadcast_bound(spark, images, tmp, monkeypatch, limit):
    p = f"{tmp}/tb_image"
    monkeypatch.setattr(keys, "BROADCAST_KEYS", limit)
    monkeypatch.setattr(keys, "LISTED_HOURS", 2)
    writers.write_images(images.filter("hash(img_filename) % 3 = 0"), p)
    writers.write_images(images.unionByName(images.filter("hash(img_filename) % 5 = 0")), p)
    assert stored(spark, p) == sorted(map(tuple, images.select("img_filename", "image").collect()))


@pytest.mark.parametrize("broken", ["before the table", "within the table", "before the index", "before it is struck off"])
def test_a_broken_run_is_settled_by_the_next(spark, images, tmp, monkeypatch, broken):
    p = f"{tmp}/tb_image"
    first, second = images.filter("capture_time < '2024-01-10'"), images.filter("capture_time >= '2024-01-08'")
    writers.write_images(first, p)

    def fail(*args, **kwargs):
        raise OSError("lost")

    with monkeypatch.context() as m:
        if broken == "before the table":
            m.setattr(keys, "unstored", fail)
        elif broken == "within the table":  # some of the rows were committed
            whole = keys.unstored

            def some(rows, marked, on):
                whole(rows, marked, on).where("hash(img_filename) % 2 = 0").write.mode("append").partitionBy("year_id", "month_id").parquet(p)
                raise OSError("lost")
            m.setattr(keys, "unstored", some)
        elif broken == "before the index":
            m.setattr(keys, "_add", fail)
        else:
            m.setattr(keys, "remove", fail)
        with pytest.raises(OSError):
            writers.write_images(second, p)
    writers.write_images(second, p)
    want = sorted(map(tuple, images.select("img_filename", "image").collect()))
    assert stored(spark, p) == want
    index = spark.read.parquet(keys.index_path(p))
    assert index.count() == len(want) == index.select(*KEY).distinct().count()
    assert keys.children(spark, keys.pending_path(p)) == []


def test_a_table_from_before_the_index(spark, images, tmp):
    p = f"{tmp}/tb_image"
    parts = images.withColumns({"year_id": F.lit(2024), "month_id": F.lit(1)})
    parts.filter("capture_time < '2024-01-10'").write.partitionBy("year_id", "month_id").parquet(p)
    writers.write_images(images, p)
    assert stored(spark, p) == sorted(map(tuple, images.select("img_filename", "image").collect()))


def test_null_keys_and_instants(spark, tmp):
    df = spark.createDataFrame([(None, None, "a"), (None, None, "a"), ("k", None, "b"), ("k", None, "b"), ("m", None, "c")], "k string, t timestamp, v string")
    for _ in range(2):
        keys.append_indexed(df, f"{tmp}/t", ["k"], "t")
        assert sorted(r.v for r in spark.read.parquet(f"{tmp}/t").collect()) == ["a", "b", "c"]
    keys.append_indexed(df.limit(0), f"{tmp}/t", ["k"], "t")
    assert spark.read.parquet(f"{tmp}/t").count() == 3
