import json
import os

import pytest
from pyspark.sql import functions as F

from vertebra.operators.inference import infer_landmarks, recorded_landmarks_factory
from vertebra.plans import catalog
from vertebra.sources.files import frame_file_stream, landing_stream, read_frames
from vertebra.streaming import jobs


# the 'image' of a test frame carries its landmarks as JSON
stub_factory = recorded_landmarks_factory()


def write_frame_files(spark, folder, start=0, n=60):
    """One indented JSON object per file, like the camera consumer writes."""
    os.makedirs(folder, exist_ok=True)
    fr = (catalog.frames(spark, "/root/testdata/sf0.001")
          .filter((F.col("event_id") >= start) & (F.col("event_id") < start + n))
          .select("event_id", "ts", "lm").orderBy("event_id").collect())
    from vertebra.functions.timeparts import message_ts_text
    for r in fr:
        ts = spark.createDataFrame([(r.ts,)], "ts timestamp_ntz").select(message_ts_text("ts")).first()[0]
        img = json.dumps(r.lm if r.lm is not None else {"no": "pose"}).encode().hex()
        with open(os.path.join(folder, f"kafka_{r.event_id}.json"), "w") as fh:
            json.dump({"timestamp": ts, "image_data": img}, fh, indent=4)
    return len(fr)


def test_infer_landmarks(spark):
    df = spark.createDataFrame([(1, json.dumps([0.1] * 12).encode()), (2, b"{}"), (3, None)],
                               "id int, image binary")
    got = {r.id: r.lm for r in infer_landmarks(df, stub_factory, partitions=2).collect()}
    assert got[1] == [0.1] * 12 and got[2] is None and got[3] is None


def test_inference_passes_other_columns_untouched(spark):
    """Integers with NULLs, decimals, nested values, dates and times come back as they went (pandas would widen some)."""
    import datetime as dt
    import decimal
    rows = [(1, None, decimal.Decimal("1.50"), {"a": [1, None]}, (2, "x"), dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 12), json.dumps([0.5] * 12).encode()),
            (None, 7, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a long, b int, c decimal(9,2), d map<string,array<int>>, e struct<x:int,y:string>, f date, g timestamp, image binary")
    got = infer_landmarks(df, stub_factory, partitions=3)
    assert got.schema[:-1] == df.schema[:] and got.columns[-1] == "lm"
    assert sorted(map(str, got.drop("lm").collect())) == sorted(map(str, df.collect()))
    assert sorted(str(r.lm) for r in got.collect()) == sorted([str([0.5] * 12), "None"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


@pytest.fixture(scope="module")
def frame_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("frames") / "in")
    write_frame_files(spark, d, 0, 60)
    return d


def test_batch_equals_stream_and_restart(spark, frame_dir, tmp_path):
    base_b, base_s, ckpt = str(tmp_path / "b"), str(tmp_path / "s"), str(tmp_path / "ck")
    analyzed, bad = jobs.process_frames(read_frames(spark, frame_dir), stub_factory)
    jobs.load_frames(analyzed, base_b)
    q = jobs.start_pipeline(frame_file_stream(spark, frame_dir), base_s, ckpt, stub_factory,
                            trigger={"availableNow": True})
    q.awaitTermination(300)
    seen = sum(p["observedMetrics"]["ingest"]["n_messages"] for p in q.recentProgress
               if p.get("observedMetrics"))
    assert seen == 60  # live counter: each message counted once
    cols = ["posture_id", "posture_status", "cva_left_value", "day_id"]
    b = spark.read.parquet(f"{base_b}/tb_posture").select(*cols)
    s = spark.read.parquet(f"{base_s}/tb_posture").select(*cols)
    assert b.count() == 60 and b.exceptAll(s).count() == 0 and s.exceptAll(b).count() == 0
    assert spark.read.text(f"{base_s}/feed").count() == 60
    # restart on the same checkpoint: nothing is read twice
    q = jobs.start_pipeline(frame_file_stream(spark, frame_dir), base_s, ckpt, stub_factory,
                            trigger={"availableNow": True})
    q.awaitTermination(300)
    assert spark.read.parquet(f"{base_s}/tb_posture").count() == 60
    # new files only
    write_frame_files(spark, frame_dir, 60, 20)
    q = jobs.start_pipeline(frame_file_stream(spark, frame_dir), base_s, ckpt, stub_factory,
                            trigger={"availableNow": True})
    q.awaitTermination(300)
    assert spark.read.parquet(f"{base_s}/tb_posture").count() == 80
    # loader over the landing zone rebuilds the same facts without inferring again
    base_l = str(tmp_path / "l")
    q = jobs.start_loader(landing_stream(spark, f"{base_s}/landing"), base_l, str(tmp_path / "ck2"),
                          trigger={"availableNow": True})
    q.awaitTermination(300)
    lf = spark.read.parquet(f"{base_l}/tb_posture").select("posture_id", "posture_status", "cva_left_value")
    sf = spark.read.parquet(f"{base_s}/tb_posture").select("posture_id", "posture_status", "cva_left_value")
    assert lf.count() == 80 and lf.exceptAll(sf).count() == 0
    # the loader's facts carry landmarks, so its daily mart equals the live one
    from vertebra.operators.mart import daily_stat
    ml = daily_stat(spark.read.parquet(f"{base_l}/tb_posture"))
    ms = daily_stat(spark.read.parquet(f"{base_s}/tb_posture"))
    assert ml.count() > 0 and ml.exceptAll(ms).count() == 0 and ms.exceptAll(ml).count() == 0
    assert spark.read.parquet(f"{base_l}/tb_day").count() == \
        spark.read.parquet(f"{base_l}/tb_day").select("year_id", "month_id", "day_id").distinct().count()


def test_live_status_stream(spark, frame_dir, tmp_path):
    stream = frame_file_stream(spark, frame_dir)
    analyzed, _ = jobs.process_frames(stream, stub_factory)
    q = jobs.live_status_stream(analyzed, str(tmp_path / "ck"), query_name="live_t",
                                trigger={"availableNow": True})
    q.awaitTermination(300)
    rows = spark.sql("SELECT * FROM live_t").collect()
    assert len(rows) == 1 and rows[0].user_id == "default"
    assert rows[0].status in ("옳은 자세입니다", "자세를 바르게 해주세요")


def test_malformed_frame_files_are_quarantined(spark, frame_dir, tmp_path):
    from vertebra.operators.messages import split_valid

    assert all(r.json_ok for r in read_frames(spark, frame_dir).select("timestamp", "json_ok").collect())
    for name, text in (("ok", '{"timestamp": "2024-01-01 09:00:00.000000 +0900", "image_data": "ff"}'),
                       ("cut", '{"timestamp": "2024-'), ("junk", "no json"),
                       ("blank", '{"timestamp": "2024-01-01 09:00:00.000000 +0900", "image_data": ""}')):
        (tmp_path / f"{name}.json").write_text(text)
    good, bad = split_valid(read_frames(spark, str(tmp_path)))
    assert good.count() == 1
    got = {r.file_name.rsplit("/", 1)[1]: (r.reason, r.raw) for r in bad.collect()}
    assert got == {"cut.json": ("bad_json", '{"timestamp": "2024-'), "junk.json": ("bad_json", "no json"),
                   "blank.json": ("bad_hex", None)}


def test_loader_reinfers_reference_format_documents(spark, tmp_path):
    from vertebra.schemas import LANDED_DOCUMENT
    d = tmp_path / "landing"
    d.mkdir()
    lm = [0.1, 0.2, 0.0, 0.3, 0.2, 0.0, 0.15, 0.05, -0.1, 0.25, 0.05, -0.1]
    for i in range(3):
        doc = {"image_data": json.dumps(lm).encode().hex(),
               "timestamp": f"2024-01-0{i + 1} 09:00:00.000000 +0900",
               "analysis_result": {"cva_left": 1.0, "cva_right": 2.0, "fha_left": 3.0,
                                   "fha_right": 4.0, "posture_correct": False}}
        (d / f"{i}.json").write_text(json.dumps(doc, indent=4))
    landed = spark.read.schema(LANDED_DOCUMENT).option("multiLine", True).json(str(d))
    without = jobs.landed_to_frames(landed).collect()
    assert all(r.landmarks is None for r in without)
    redone = jobs.landed_to_frames(landed, estimator_factory=stub_factory).collect()
    assert len(redone) == 3 and all(r.landmarks is not None for r in redone)
    assert all(r.cva_left == 1.0 for r in redone)  # the stored result is kept


def test_redelivered_frames_dropped_before_inference(spark, frame_dir, tmp_path):
    import shutil
    d = tmp_path / "dups"
    shutil.copytree(frame_dir, d)
    for f in list(d.iterdir())[:10]:
        shutil.copy(f, d / f"copy_{f.name}")
    stream = frame_file_stream(spark, str(d))
    analyzed, _ = jobs.process_frames(stream, stub_factory, dedup_watermark="10 minutes")
    q = (analyzed.select("frame_key").writeStream.format("memory").queryName("dedup_t")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    n_files = len(list(d.iterdir()))
    got = spark.sql("select count(*) n, count(distinct frame_key) k from dedup_t").first()
    assert got.n == got.k == n_files - 10
    q = jobs.start_pipeline(frame_file_stream(spark, str(d)), str(tmp_path / "out"), str(tmp_path / "ck2"),
                            stub_factory, trigger={"availableNow": True}, dedup_watermark="10 minutes")
    q.awaitTermination(300)
    assert spark.read.text(str(tmp_path / "out" / "feed")).count() == n_files - 10


def test_daily_counts_stream_matches_batch(spark, frame_dir, tmp_path):
    from vertebra.functions.timeparts import local_time
    stream = frame_file_stream(spark, frame_dir)
    analyzed, _ = jobs.process_frames(stream, stub_factory)
    q = jobs.daily_counts_stream(analyzed, str(tmp_path / "ck"), query_name="days_t",
                                 trigger={"availableNow": True})
    q.awaitTermination(300)
    got = {(str(r.d), r.posture_correct): r.cnt for r in spark.sql(
        "select to_date(from_utc_timestamp(day.start, 'Asia/Seoul')) d, posture_correct, cnt from days_t").collect()}
    batch, _ = jobs.process_frames(read_frames(spark, frame_dir), stub_factory)
    exp = {(str(r.d), r.posture_correct): r["count"] for r in batch.filter("posture_correct is not null")
           .groupBy(F.to_date(local_time("event_ts")).alias("d"), "posture_correct").count().collect()}
    assert got and all(exp[k] == v for k, v in got.items())  # finalised days equal the batch counts


def test_landing_file_sink_exactly_once(spark, frame_dir, tmp_path):
    analyzed, _ = jobs.process_frames(frame_file_stream(spark, frame_dir), stub_factory)
    for _ in range(2):  # a restart on the same checkpoint writes nothing twice
        q = jobs.start_landing_sink(analyzed, str(tmp_path / "landing"), str(tmp_path / "ck"),
                                    trigger={"availableNow": True})
        q.awaitTermination(300)
    n_files = len([f for f in os.listdir(frame_dir) if f.endswith(".json")])
    back = spark.read.schema(__import__("vertebra.schemas", fromlist=["x"]).LANDED_DOCUMENT) \
        .json(str(tmp_path / "landing"))
    assert back.count() == n_files


def test_undecodable_rows_survive_the_dedup_switch(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for i in range(5):
        (d / f"bad{i}.json").write_text("{not json")
    for i in range(3):  # one frame, delivered three times
        (d / f"ok{i}.json").write_text('{"timestamp": "2024-01-01 09:00:00.000000 +0900", "image_data": "ffd8"}')
    q = jobs.start_pipeline(frame_file_stream(spark, str(d)), str(tmp_path / "out"), str(tmp_path / "ck"),
                            stub_factory, trigger={"availableNow": True}, dedup_watermark="10 minutes")
    q.awaitTermination(300)
    bad = spark.read.parquet(str(tmp_path / "out" / "quarantine"))
    assert bad.count() == 5 and bad.filter("raw like '%not json%'").count() == 5
    assert spark.read.text(str(tmp_path / "out" / "feed")).count() == 1


def test_two_users_at_one_instant_are_two_facts(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 09:00:00.000000 +0900", "ffd8", u) for u in ("a", "b", "b")],
                               "timestamp string, image_data string, who string")
    analyzed, _ = jobs.process_frames(df, stub_factory, "who")
    jobs.load_frames(analyzed, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "tb_posture")).count() == 2


def test_load_keeps_the_callers_cache(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 09:00:00.000000 +0900", "ffd8")], "timestamp string, image_data string")
    analyzed = jobs.process_frames(df, stub_factory)[0].persist()
    jobs.load_frames(analyzed, str(tmp_path))
    assert analyzed.is_cached and analyzed.storageLevel.useMemory
    analyzed.unpersist()


def test_recorded_landmarks_tolerate_nulls():
    from vertebra.operators.inference import recorded_landmarks_factory
    got = recorded_landmarks_factory()()([b"[null,1,1,1,1,1,1,1,1,1,1,1]", b"[1,1,1,1,1,1,1,1,1,1,1,2]", b""])
    assert got == [None, [1.0] * 11 + [2.0], None]


def test_decoded_message_keeps_raw_text(spark):
    from vertebra.operators.messages import decode_messages
    df = spark.createDataFrame([(b"{oops",), (b'{"timestamp": "t", "image_data": "00"}',)], "value binary")
    assert {r.raw for r in decode_messages(df).collect()} == {"{oops", None}
