"""The archive, image and cleaning jobs, and the replay of a topic."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F
from test_streaming import write_frame_files

from vertebra import cli
from vertebra.operators import warehouse
from vertebra.schemas import FRAME_MESSAGE
from vertebra.sources import files


def messages(folder):
    return sorted((d["timestamp"], d["image_data"]) for d in (json.load(open(os.path.join(folder, f))) for f in os.listdir(folder)))


def archived(spark, path):
    rows = spark.read.schema("archive_name string, timestamp string, image_data string, raw string, ingest_date string").json(path)
    return rows.collect()


def test_archive_job_adds_nothing_on_replay(spark, tmp):
    write_frame_files(spark, f"{tmp}/in", 0, 20)
    want = messages(f"{tmp}/in")
    open(f"{tmp}/in/broken.json", "w").write("{ no json")
    job = ["archive", "--input", f"{tmp}/in", "--out", f"{tmp}/out", "--checkpoint", f"{tmp}/ck", "--once"]
    cli.main(job)
    got = archived(spark, f"{tmp}/out/archive")
    good = [r for r in got if r.timestamp]
    assert sorted((r.timestamp, r.image_data) for r in good) == want
    for r in good:  # name and folder, from the message's own text
        assert r.archive_name == "kafka_" + r.timestamp.replace(":", "-").replace(" ", "_") + ".json"
        assert r.ingest_date == r.timestamp[:10].replace("-", "")
    assert [r.raw for r in got if not r.timestamp] == ["{ no json"]
    # a crash between the sink's commit and the checkpoint's: the batch is replayed
    for f in os.listdir(f"{tmp}/ck/commits"):
        os.remove(f"{tmp}/ck/commits/{f}")
    cli.main(job)
    assert sorted(map(str, archived(spark, f"{tmp}/out/archive"))) == sorted(map(str, got))
    write_frame_files(spark, f"{tmp}/in", 20, 5)
    cli.main(job)
    assert len(archived(spark, f"{tmp}/out/archive")) == len(got) + 5


@pytest.mark.parametrize("mode", ["archive", "delete"])
def test_loader_cleans_the_files_of_committed_batches(spark, tmp, mode):
    write_frame_files(spark, f"{tmp}/in", 0, 12)
    cli.main(["live", "--input", f"{tmp}/in", "--out", f"{tmp}/live", "--checkpoint", f"{tmp}/ck0", "--once",
              "--estimator", "recorded", "--no-tables"])
    os.makedirs(f"{tmp}/land")
    landed = [os.path.join(d, f) for d, _, fs in os.walk(f"{tmp}/live/landing") for f in fs if f.endswith(".json")]
    docs = [line for f in sorted(landed) for line in open(f).read().splitlines()]
    open(f"{tmp}/land/first.json", "w").write("\n".join(docs[:7]))
    job = ["loader", "--input", f"{tmp}/land", "--out", f"{tmp}/wh", "--checkpoint", f"{tmp}/ck", "--once",
           "--clean-source", mode, *(["--archive-dir", f"{tmp}/done"] if mode == "archive" else [])]
    cli.main(job)
    assert os.listdir(f"{tmp}/land") and spark.read.parquet(f"{tmp}/wh/tb_posture").count() == 7
    open(f"{tmp}/land/second.json", "w").write("\n".join(docs[7:]))
    cli.main(job)
    assert spark.read.parquet(f"{tmp}/wh/tb_posture").count() == len(docs)
    assert "first.json" not in os.listdir(f"{tmp}/land") and "second.json" in os.listdir(f"{tmp}/land")
    kept = {f: os.path.join(d, f) for d, _, fs in os.walk(f"{tmp}/done") for f in fs}
    assert set(kept) == ({"first.json"} if mode == "archive" else set())
    if mode == "archive":
        assert open(kept["first.json"]).read() == "\n".join(docs[:7])


def test_cleaning_needs_its_folder(tmp):
    with pytest.raises(SystemExit):
        cli.main(["loader", "--input", tmp, "--out", tmp, "--checkpoint", tmp, "--clean-source", "archive"])


def test_day_images_from_table_and_folder(spark, tmp, monkeypatch):
    write_frame_files(spark, f"{tmp}/in", 0, 60)
    cli.main(["load", "--input", f"{tmp}/in", "--out", f"{tmp}/wh", "--estimator", "recorded"])
    facts, stored = spark.read.parquet(f"{tmp}/wh/tb_posture"), spark.read.parquet(f"{tmp}/wh/tb_image")
    every = {r.img_filename: bytes(r.image) for r in stored.collect()}
    os.makedirs(f"{tmp}/blobs/sub")
    for i, (name, data) in enumerate(sorted(every.items())):
        open(f"{tmp}/blobs/{'sub/' if i % 2 else ''}{name}", "wb").write(data)
    d = facts.where("posture_status is not null").select("year_id", "month_id", "day_id").first()
    day = f"{d.year_id:04d}-{d.month_id:02d}-{d.day_id:02d}"
    plain = [r for r in facts.collect() if (r.year_id, r.month_id, r.day_id) == tuple(d) and r.posture_status is not None]
    for choice in (None, "correct", "incorrect"):
        want = sorted((r.img_filename, r.posture_status, every[r.img_filename]) for r in plain
                      if choice is None or r.posture_status == (choice == "correct"))
        for source in ([], ["--images", f"{tmp}/blobs"]):
            cli.main(["images", "--out", f"{tmp}/wh", "--day", day, "--dest", f"{tmp}/day", *source,
                      *(["--class", choice] if choice else [])])
            got = sorted((r.img_filename, r.posture_status, bytes(r.image)) for r in spark.read.parquet(f"{tmp}/day").collect())
            assert got == want
    plan = warehouse.day_images(facts, stored, *d)._jdf.queryExecution().toString()
    assert "capture_time" in plan.split("PushedFilters")[-1] or "GreaterThanOrEqual(capture_time" in plan
    # only the wanted files are opened: all others are unreadable now
    names = warehouse.day_class(facts, *d).select("img_filename")
    wanted = {r.img_filename for r in names.collect()}
    read = files.read_images(spark, f"{tmp}/blobs", names)
    assert {p.rsplit("/", 1)[1] for p in read.inputFiles()} == wanted and 0 < len(wanted) <= len(every)
    monkeypatch.setattr(files, "NAMED_FILES", 0)  # more than that: the folder's scan, the same rows
    again = files.read_images(spark, f"{tmp}/blobs", names)
    assert sorted(map(str, again.collect())) == sorted(map(str, read.collect()))
    assert files.read_images(spark, f"{tmp}/blobs", names.limit(0)).count() == 0


def test_names_with_pattern_characters(spark, tmp):
    os.makedirs(f"{tmp}/blobs")
    for name in ("a[1].png", "a1.png", "b{x,y}.png", "c*.png", "cd.png", "e f%20.png"):
        open(f"{tmp}/blobs/{name}", "wb").write(name.encode())
    want = ["a[1].png", "b{x,y}.png", "c*.png", "e f%20.png", "absent.png"]
    got = files.read_images(spark, f"{tmp}/blobs", spark.createDataFrame([(w,) for w in want], "img_filename string"))
    assert sorted((r.img_filename, bytes(r.image).decode()) for r in got.collect()) == sorted((w, w) for w in want[:-1])


def test_load_replays_a_topic(spark, tmp, monkeypatch):
    n = write_frame_files(spark, f"{tmp}/in", 0, 10)
    # the connector jar is absent: the topic's messages come from the frame files
    topic = spark.read.schema(FRAME_MESSAGE).option("multiLine", True).json(f"{tmp}/in").select(
        F.to_json(F.struct("timestamp", "image_data")).cast("binary").alias("value"))
    asked = []
    monkeypatch.setattr(cli, "replay_frames", lambda s, servers, name: asked.append((servers, name)) or topic.unionAll(
        s.createDataFrame([(bytearray(b"{ no json"),)], "value binary")))
    for _ in range(2):  # a replay adds nothing
        cli.main(["load", "--kafka", "h1:9092,h2:9092/frames", "--out", f"{tmp}/wh", "--estimator", "recorded"])
        assert spark.read.parquet(f"{tmp}/wh/tb_posture").count() == n
        assert [r.raw for r in spark.read.parquet(f"{tmp}/wh/quarantine").collect()] == ["{ no json"]
    assert asked[0] == ("h1:9092,h2:9092", "frames")
    shutil.copytree(f"{tmp}/in", f"{tmp}/in2")
    cli.main(["load", "--input", f"{tmp}/in2", "--out", f"{tmp}/wh", "--estimator", "recorded"])
    assert spark.read.parquet(f"{tmp}/wh/tb_posture").count() == n
