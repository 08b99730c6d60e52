from pyspark.sql import functions as F

from vertebra.operators import warehouse
from vertebra.plans import catalog
from vertebra.sinks import writers

SF = "/root/testdata/sf0.001"


def test_daily_job_twice_same_rows(spark, tmp):
    m = catalog.mart(spark, SF)
    p = f"{tmp}/daily"
    writers.write_daily_stat(m, p)
    writers.write_daily_stat(m, p)
    got = spark.read.parquet(p)
    assert got.count() == m.count()
    assert got.select("daily_stat_id").distinct().count() == m.count()


def test_same_frame_twice_one_fact(spark, tmp):
    f = catalog.facts(spark, SF).drop("landmarks")
    p = f"{tmp}/facts"
    writers.write_facts(f.unionByName(f), p)
    writers.write_facts(f, p)
    got = spark.read.parquet(p)
    assert got.count() == f.count() == got.select("posture_id").distinct().count()


def test_dimension_upsert_idempotent(spark, tmp):
    f = catalog.facts(spark, SF)
    day = warehouse.calendar_dims(f)["day"]
    p = f"{tmp}/tb_day"
    writers.append_new(day.filter("day_id < 10"), p, warehouse.DIM_KEYS["day"])
    writers.append_new(day, p, warehouse.DIM_KEYS["day"])
    writers.append_new(day, p, warehouse.DIM_KEYS["day"])
    assert spark.read.parquet(p).count() == day.count()


def test_star_join_no_fan_out(spark):
    f = catalog.facts(spark, SF)
    s = warehouse.star(f, warehouse.to_dims(f))
    assert s.count() == f.count()
    assert s.filter(F.col("day_value").isNull() | F.col("user_name").isNull()).count() == 0


def test_star_in_one_pass_equals_the_joins(spark):
    """Also for frames without a user, an instant or an image."""
    a = catalog.analyzed(spark, SF).withColumn("image", F.encode("props", "UTF-8"))
    a = a.withColumns({"user_id": F.when(F.col("event_id") % 11 != 0, F.col("user_id")), "ts": F.when(F.col("event_id") % 13 != 0, F.col("ts")),
                       "image": F.when(F.col("event_id") % 17 != 0, F.col("image"))})
    f = warehouse.to_facts(a)
    joined = warehouse.star(f, warehouse.to_dims(f), warehouse.to_images(a).dropDuplicates(["img_filename"]).filter("img_filename IS NOT NULL"))
    got = warehouse.star_frames(a)
    keyed = F.col("posture_id").isNotNull()
    cols = sorted(joined.columns)
    assert cols == sorted(got.columns)
    assert sorted(map(str, joined.filter(keyed & F.col("timestamp").isNotNull()).select(cols).collect())) == \
        sorted(map(str, got.filter(keyed & F.col("timestamp").isNotNull()).select(cols).collect()))
    assert got.count() == a.count()


def test_attach_images_and_binary_source(spark, tmp):
    import os
    os.makedirs(f"{tmp}/img")
    for i in range(3):
        with open(f"{tmp}/img/image_{i}.jpg", "wb") as fh:
            fh.write(bytes([255, 216, i]))
    imgs = __import__("vertebra.sources.files", fromlist=["x"]).read_images(spark, f"{tmp}/img")
    facts = spark.createDataFrame([("image_1.jpg", True)], "img_filename string, posture_status boolean")
    r = warehouse.attach_images(facts, imgs).collect()
    assert len(r) == 1 and bytes(r[0].image) == bytes([255, 216, 1]) and r[0].file_size == 3


def test_append_new_reads_only_touched_partitions(spark, tmp):
    f = catalog.facts(spark, SF).drop("landmarks")
    p = f"{tmp}/facts_p"
    writers.append_new(f.filter("day_id < 20"), p, ["posture_id"], writers.FACT_PARTITIONS)
    later = f.filter("day_id >= 20")
    added = writers.append_new(later, p, ["posture_id"], writers.FACT_PARTITIONS)
    plan = added._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in plan.splitlines() if "FileScan" in ln and "struct<posture_id:string>" in ln]
    assert scan and "month_id" in scan[0].split("PartitionFilters: [")[1].split("]")[0]
    assert spark.read.parquet(p).count() == f.count()


def test_emptied_day_is_emptied(spark, tmp):
    import datetime as dt

    from vertebra.sinks import writers
    rows = [(2024, 1, 1, "a"), (2024, 1, 2, "b")]
    mart = spark.createDataFrame(rows, "year_id int, month_id int, day_id int, img_filename string")
    writers.write_daily_stat(mart, f"{tmp}/emptied")
    writers.write_daily_stat(mart.filter("false"), f"{tmp}/emptied", dt.date(2024, 1, 1))
    assert [r.day_id for r in spark.read.parquet(f"{tmp}/emptied").collect()] == [2]


def test_event_without_a_vector_stays_a_frame(spark, tmp):
    from vertebra.sources.fixtures import frames
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/events.parquet").limit(20).selectExpr(
        "event_id - 10 AS event_id", "* EXCEPT (event_id)").write.parquet(f"{tmp}/neg/events.parquet")
    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 0").write.parquet(f"{tmp}/neg/embeddings.parquet")
    assert frames(spark, f"{tmp}/neg").count() == 20
