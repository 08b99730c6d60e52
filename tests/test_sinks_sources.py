import json
import os

from pyspark.sql import functions as F

from vertebra.operators.codec_ops import archive_frames_names
from vertebra.plans import catalog
from vertebra.sinks import writers
from vertebra.sources.fixtures import frame_messages
from vertebra.sources.kafka import kafka_options

SF = "/root/testdata/sf0.001"


def test_archive_frames_per_local_day(spark, tmp):
    m = frame_messages(spark, SF).withColumnRenamed("ts", "event_ts")
    writers.archive_frames(m, f"{tmp}/arch")
    back = spark.read.json(f"{tmp}/arch")
    assert back.count() == m.count()
    days = {r.ingest_date for r in back.select("ingest_date").distinct().collect()}
    assert "20240101" in {str(d) for d in days}
    assert back.filter(F.col("archive_name").startswith("kafka_")).count() == m.count()


def test_archive_names(spark):
    m = frame_messages(spark, SF)
    r = archive_frames_names(m, keep=("event_id",)).filter("event_id = 0").first()
    assert r.archive_name.startswith("kafka_2024-01-01_09-") and r.archive_name.endswith("+0900.json")
    assert ":" not in r.archive_name and " " not in r.archive_name


def test_kafka_options():
    o = kafka_options("broker:9092", "frames-in", "earliest", "g1", {"endingOffsets": "latest"})
    assert o == {"kafka.bootstrap.servers": "broker:9092", "subscribe": "frames-in",
                 "startingOffsets": "earliest", "kafka.group.id": "g1", "endingOffsets": "latest"}


def test_landing_documents_shape(spark, tmp):
    a = catalog.analyzed(spark, SF).limit(5).withColumns(
        {"image_data": F.lit("ffd8"), "timestamp": F.lit("2024-01-01 09:00:00.000000 +0900")})
    writers.write_landing(a, f"{tmp}/landing", batch_id=3)
    writers.write_landing(a, f"{tmp}/landing", batch_id=3)  # replayed batch overwrites itself
    files = [f for f in os.listdir(f"{tmp}/landing/batch_id=3") if f.endswith(".json")]
    docs = [json.loads(line) for f in files for line in open(f"{tmp}/landing/batch_id=3/{f}")]
    assert len(docs) == 5
    assert set(docs[0]) == {"image_data", "timestamp", "analysis_result", "lm"}
    assert set(docs[0]["analysis_result"]) == {"cva_left", "cva_right", "fha_left", "fha_right",
                                               "posture_correct"}


def test_cut_lineage_uses_shared_checkpoint_dir(spark):
    from vertebra.session import cut_lineage
    df = cut_lineage(catalog.mart(spark, SF))
    assert df.count() > 0
    base = spark.conf.get("spark.checkpoint.dir").replace("file:", "").rstrip("/")
    assert spark.sparkContext.getCheckpointDir().replace("file:", "").startswith(base)


def test_landing_stream_clean_source_option(spark, tmp):
    from vertebra.sources.files import landing_stream
    a = catalog.analyzed(spark, SF).limit(4).withColumns(
        {"image_data": F.lit("ffd8"), "timestamp": F.lit("2024-01-01 09:00:00.000000 +0900")})
    writers.write_landing(a, f"{tmp}/landing")
    os.makedirs(f"{tmp}/done")
    s = landing_stream(spark, f"{tmp}/landing", clean_source="archive", archive_dir=f"{tmp}/done")
    q = (s.writeStream.format("memory").queryName("landed_t").option("checkpointLocation", f"{tmp}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert spark.sql("select * from landed_t").count() == 4
