"""Job entry points: ``python -m vertebra.cli <job> ...``.

  load     frame JSON files, or all messages that a topic holds -> facts, images,
           dimensions (batch job)
  daily    facts -> daily mart, all days or one day (idempotent per day)
  live     frame stream (Kafka or a folder of frame files) -> feed, landing, quarantine, tables
  loader   landing-zone stream -> facts, images, dimensions; with --clean-source the files
           of a batch are archived or deleted once the next batch begins (of the last batch
           of a run: by the next run that finds new files)
  archive  frame stream -> messages under one folder per local day
  images   the images of one day's frames, with their class, from the image table or a folder
  status   frame stream -> live status table (newest result per user), or with --counts
           the frames per local day and class
  report   calendar | daily | weekly | weekly-landmarks | weekly-chart | daily-chart
           over the stored mart (JSON lines), live over the status table

The pose model is a plug-in: ``--estimator recorded`` reads landmarks carried
in the payload; ``--estimator mediapipe`` needs MediaPipe and OpenCV.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import functions as F

from .functions.timeparts import DEFAULT_TZ, instant_range
from .operators import mart as mart_ops
from .operators import reports, warehouse
from .operators.inference import mediapipe_estimator_factory, recorded_landmarks_factory
from .session import build_session
from .sinks import writers
from .sources.files import frame_file_stream, landing_stream, read_frames, read_images
from .sources.kafka import frame_stream, replay_frames
from .streaming import jobs
from .streaming.upserts import read_upserts


def _estimator(name: str):
    return {"recorded": recorded_landmarks_factory, "mediapipe": mediapipe_estimator_factory}[name]()


def cmd_load(spark, a) -> None:
    frames = replay_frames(spark, *a.kafka.split("/", 1)) if a.kafka else read_frames(spark, a.input)
    analyzed, bad = jobs.process_frames(frames, _estimator(a.estimator),
                                        a.user_id and F.lit(a.user_id), a.partitions)
    jobs.load_frames(analyzed, a.out, a.tz)
    # once per file (none for a topic) and row, however often it is loaded
    name = F.col("file_name") if "file_name" in bad.columns else F.lit(None).cast("string").alias("file_name")
    bad = bad.select(name, "timestamp", "reason", "raw")
    writers.append_new(bad, writers.table_path(a.out, "quarantine"), bad.columns)


def cmd_daily(spark, a) -> None:
    facts = spark.read.parquet(writers.table_path(a.out, "tb_posture"))
    if a.day:
        d = dt.date.fromisoformat(a.day)
        facts = facts.filter(instant_range("timestamp", d, d, tz=None)  # row groups by statistics
                             & (F.col("year_id") == d.year) & (F.col("month_id") == d.month)
                             & (F.col("day_id") == d.day))
    writers.write_daily_stat(mart_ops.daily_stat(facts, by_user=a.by_user),
                             writers.table_path(a.out, "tb_daily_stat"), d if a.day else None)


def _frames(spark, a):
    """The frame stream of a job, and its trigger."""
    if a.kafka:
        servers, topic = a.kafka.split("/", 1)
        stream = frame_stream(spark, servers, topic, max_offsets_per_trigger=a.max_per_trigger)
    else:
        stream = frame_file_stream(spark, a.input, max_files_per_trigger=a.max_per_trigger)
    return stream, {"availableNow": True} if a.once else {"processingTime": a.trigger}


def cmd_live(spark, a) -> None:
    stream, trigger = _frames(spark, a)
    q = jobs.start_pipeline(stream, a.out, a.checkpoint, _estimator(a.estimator), trigger,
                            a.user_id and F.lit(a.user_id), a.partitions, not a.no_tables, a.tz,
                            a.dedup_watermark)
    q.awaitTermination()


def cmd_status(spark, a) -> None:
    stream, trigger = _frames(spark, a)
    user, est = a.user_id and F.lit(a.user_id), _estimator(a.estimator)
    if a.counts:
        q = jobs.start_daily_counts(stream, writers.table_path(a.out, "tb_daily_count"), a.checkpoint, est, trigger, user, a.partitions, a.tz)
    else:
        q = jobs.start_live_status(stream, writers.table_path(a.out, "tb_live_status"), a.checkpoint, est, trigger, user, a.partitions)
    q.awaitTermination()


def cmd_loader(spark, a) -> None:
    trigger = {"availableNow": True} if a.once else {"processingTime": a.trigger}
    landed = landing_stream(spark, a.input, clean_source=a.clean_source, archive_dir=a.archive_dir)
    q = jobs.start_loader(landed, a.out, a.checkpoint, trigger,
                          a.user_id and F.lit(a.user_id), a.tz)
    q.awaitTermination()


def cmd_archive(spark, a) -> None:
    stream, trigger = _frames(spark, a)
    jobs.start_archive(stream, writers.table_path(a.out, "archive"), a.checkpoint, trigger, a.tz).awaitTermination()


def cmd_images(spark, a) -> None:
    d = dt.date.fromisoformat(a.day)
    posture = {None: None, "correct": True, "incorrect": False}[a.posture]
    facts = spark.read.parquet(writers.table_path(a.out, "tb_posture"))
    if a.images:
        wanted = warehouse.day_class(facts, d.year, d.month, d.day, posture)
        rows = warehouse.attach_images(wanted, read_images(spark, a.images, wanted))
    else:
        stored = spark.read.parquet(writers.table_path(a.out, "tb_image"))
        rows = warehouse.day_images(facts, stored, d.year, d.month, d.day, posture)
    rows.write.mode("overwrite").parquet(a.dest)  # a re-run replaces the result


def cmd_report(spark, a) -> None:
    if a.kind == "live":
        rows = read_upserts(spark, writers.table_path(a.out, "tb_live_status"), jobs.STATUS_KEYS)
        rows = rows.filter(F.col("user_id") == a.user_id) if rows is not None and a.user_id else rows
        for row in rows.orderBy(F.desc("event_ts")).limit(a.rows).toJSON().collect() if rows is not None else []:
            sys.stdout.write(row + "\n")
        return
    mart = spark.read.parquet(writers.table_path(a.out, "tb_daily_stat"))
    if a.kind == "calendar":
        df = reports.calendar_map_value(mart, a.year)
    elif a.kind == "daily":
        df = reports.daily_report(mart, a.date)
    elif a.kind == "weekly":
        df = reports.weekly_score(mart, a.date, a.mode)
    elif a.kind == "weekly-chart":
        df = reports.skeleton_segments(reports.weekly_landmarks(mart, a.date, a.mode), negate_y=True)
    elif a.kind == "daily-chart":
        d = dt.date.fromisoformat(a.date)
        df = reports.skeleton_segments(mart.filter((F.col("year_id") == d.year) & (F.col("month_id") == d.month)
                                                   & (F.col("day_id") == d.day)))
    else:
        df = reports.weekly_landmarks(mart, a.date, a.mode)
    # report results are a handful of rows (the API response)
    for row in df.toJSON().collect():
        sys.stdout.write(row + "\n")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="vertebra")
    p.add_argument("--master", default=None)
    p.add_argument("--tz", default=DEFAULT_TZ)
    sub = p.add_subparsers(dest="job", required=True)

    s = sub.add_parser("load")
    s.add_argument("--input", default=None)
    s.add_argument("--kafka", default=None, help="servers/topic: replay what it holds")
    s.add_argument("--out", required=True)
    s.add_argument("--estimator", required=True, choices=["recorded", "mediapipe"])
    s.add_argument("--user-id", default=None)
    s.add_argument("--partitions", type=int, default=None)

    s = sub.add_parser("daily")
    s.add_argument("--out", required=True)
    s.add_argument("--day", default=None, help="yyyy-mm-dd; all days when omitted")
    s.add_argument("--by-user", action="store_true")

    s = sub.add_parser("images")
    s.add_argument("--out", required=True)
    s.add_argument("--day", required=True, help="yyyy-mm-dd")
    s.add_argument("--class", dest="posture", default=None, choices=["correct", "incorrect"])
    s.add_argument("--images", default=None, help="folder of image files; the image table when omitted")
    s.add_argument("--dest", required=True)

    for name in ("live", "status", "loader", "archive"):
        s = sub.add_parser(name)
        s.add_argument("--input", default=None)
        s.add_argument("--out", required=True)
        s.add_argument("--checkpoint", required=True)
        s.add_argument("--trigger", default="3 seconds" if name == "loader" else "500 milliseconds")
        s.add_argument("--once", action="store_true", help="process what is there, then stop")
        if name != "archive":
            s.add_argument("--user-id", default=None)
        if name == "loader":
            s.add_argument("--clean-source", default=None, choices=["archive", "delete"])
            s.add_argument("--archive-dir", default=None, help="folder outside --input, for --clean-source archive")
        else:
            s.add_argument("--kafka", default=None, help="servers/topic")
            s.add_argument("--max-per-trigger", type=int, default=None)
        if name in ("live", "status"):
            s.add_argument("--estimator", required=True, choices=["recorded", "mediapipe"])
            s.add_argument("--partitions", type=int, default=None)
        if name == "status":
            s.add_argument("--counts", action="store_true", help="counts per local day and class instead")
        if name == "live":
            s.add_argument("--no-tables", action="store_true")
            s.add_argument("--dedup-watermark", default=None, help="e.g. '10 minutes'")

    s = sub.add_parser("report")
    s.add_argument("kind", choices=["calendar", "daily", "weekly", "weekly-landmarks", "weekly-chart",
                                    "daily-chart", "live"])
    s.add_argument("--out", required=True)
    s.add_argument("--year", type=int, default=dt.date.today().year)
    s.add_argument("--date", default=dt.date.today().isoformat())
    s.add_argument("--user-id", default=None, help="live: one user")
    s.add_argument("--rows", type=int, default=20, help="live: users shown, newest first")
    s.add_argument("--mode", default="calendar", choices=["calendar", "literal"])

    a = p.parse_args(argv)
    if a.job == "loader" and (a.clean_source == "archive") != bool(a.archive_dir):
        p.error("--clean-source archive and --archive-dir go together")
    if a.job in ("load", "live", "status", "archive") and bool(a.input) == bool(a.kafka):
        p.error("give either --input or --kafka")
    spark = build_session(a.master, app=f"vertebra-{a.job}")
    {"load": cmd_load, "daily": cmd_daily, "live": cmd_live, "status": cmd_status, "loader": cmd_loader,
     "archive": cmd_archive, "images": cmd_images, "report": cmd_report}[a.job](spark, a)


if __name__ == "__main__":
    main()
