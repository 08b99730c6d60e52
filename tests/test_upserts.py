"""Live status and day counts as running jobs: restarts, replays and snapshots lose and double nothing."""

import json
import os

import pytest
from pyspark.sql import functions as F
from test_streaming import stub_factory, write_frame_files

from vertebra.cli import main
from vertebra.sources.files import frame_file_stream, read_frames
from vertebra.streaming import jobs, upserts

NOW = {"availableNow": True}


def user():
    return F.concat(F.lit("u"), (F.length("image_data") % 3).cast("string"))


def batch(spark, folder):
    return jobs.process_frames(read_frames(spark, folder), stub_factory, user())[0]


def table(spark, path, keys):
    return sorted(map(str, upserts.read_upserts(spark, path, keys).drop("batch_id").collect()))


def want_status(spark, folder):
    return sorted(map(str, jobs.live_status_rows(batch(spark, folder)).collect()))


def run(spark, folder, base, every=2, per=4):
    q = jobs.start_live_status(frame_file_stream(spark, folder, max_files_per_trigger=per), f"{base}/status", f"{base}/ck",
                               stub_factory, NOW, user(), compact_every=every)
    q.awaitTermination(300)
    assert q.exception() is None
    return q


def test_status_survives_restarts_and_replays(spark, tmp):
    write_frame_files(spark, f"{tmp}/in", 0, 16)
    run(spark, f"{tmp}/in", tmp)
    assert table(spark, f"{tmp}/status", jobs.STATUS_KEYS) == want_status(spark, f"{tmp}/in")
    write_frame_files(spark, f"{tmp}/in", 16, 9)
    run(spark, f"{tmp}/in", tmp)
    want = want_status(spark, f"{tmp}/in")
    assert len(want) >= 2 and table(spark, f"{tmp}/status", jobs.STATUS_KEYS) == want
    # a crash after the sink, before the commit: the last batch runs again
    commits = f"{tmp}/ck/commits"
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for f in os.listdir(commits):
        if f.strip(".").startswith(last):
            os.remove(f"{commits}/{f}")
    run(spark, f"{tmp}/in", tmp)
    assert table(spark, f"{tmp}/status", jobs.STATUS_KEYS) == want
    assert len(upserts._numbered(spark, f"{tmp}/status/snapshots")) == 2


def test_counts_hold_the_open_day_and_any_zone(spark, tmp):
    write_frame_files(spark, f"{tmp}/in", 0, 30)
    for tz in ("Asia/Seoul", "America/New_York"):
        q = jobs.start_daily_counts(frame_file_stream(spark, f"{tmp}/in", max_files_per_trigger=11), f"{tmp}/{tz}/t", f"{tmp}/{tz}/ck",
                                    stub_factory, NOW, tz=tz, compact_every=2)
        q.awaitTermination(300)
        frames = jobs.process_frames(read_frames(spark, f"{tmp}/in"), stub_factory)[0]
        assert table(spark, f"{tmp}/{tz}/t", jobs.COUNT_KEYS) == sorted(map(str, jobs.daily_count_rows(frames, tz).collect()))


@pytest.mark.parametrize("every", [1, 3, 100])
def test_newest_change_wins_and_old_files_go(spark, tmp, every):
    path, want = f"{tmp}/t", {}
    assert upserts.read_upserts(spark, path, ["k"]) is None
    for n in range(8):
        rows = [(k, f"{k}-{n}" if k else None) for k in (n % 3, (n + 1) % 3, None if n % 2 else 9)]
        want.update(rows)
        df = spark.createDataFrame(rows, "k int, v string")
        for again in range(2 if n % 4 == 2 else 1):
            upserts.write_changes(df, n, path, ["k"], every)
        assert {r.k: r.v for r in upserts.read_upserts(spark, path, ["k"]).collect()} == want
    left = upserts._numbered(spark, f"{path}/changes")
    assert len(left) <= 2 * every and len(upserts._numbered(spark, f"{path}/snapshots")) <= 2
    # an unfinished folder is not read
    os.makedirs(f"{path}/changes/batch_id=8")
    assert {r.k: r.v for r in upserts.read_upserts(spark, path, ["k"]).collect()} == want


def test_status_job_and_report(spark, tmp, capsys):
    write_frame_files(spark, f"{tmp}/in", 0, 8)
    for extra, name in (([], "ck"), (["--counts"], "ck2")):
        main(["status", "--input", f"{tmp}/in", "--out", f"{tmp}/wh", "--checkpoint", f"{tmp}/{name}", "--once", "--estimator", "recorded", "--user-id", "me", *extra])
    capsys.readouterr()
    main(["report", "live", "--out", f"{tmp}/wh"])
    rows = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert len(rows) == 1 and rows[0]["user_id"] == "me"
    assert upserts.read_upserts(spark, f"{tmp}/wh/tb_daily_count", jobs.COUNT_KEYS).agg({"cnt": "sum"}).first()[0] <= 8
    main(["report", "live", "--out", f"{tmp}/empty"])
