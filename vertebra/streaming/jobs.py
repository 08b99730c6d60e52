"""Streaming jobs built from the same operators as the batch path.

``foreachBatch`` is at-least-once; every sink used here is idempotent per
micro-batch (``batch_id`` folders overwritten, key anti-joins for tables), and a
checkpoint location is mandatory, so a restart resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.codec import surrogate_key
from ..functions.timeparts import DEFAULT_TZ, local_time, parse_message_ts
from ..operators import status as status_ops
from ..operators import warehouse
from ..operators.codec_ops import archive_rows, result_feed
from ..operators.inference import Estimator, infer_landmarks
from ..operators.messages import decode_messages, split_valid
from ..operators.posture import analyze, with_landmarks
from ..sinks import writers
from .upserts import COMPACT_EVERY, start_upserts


def _user(user_id: Column | str | None) -> Column:
    if user_id is None:
        return F.lit("default")
    return F.col(user_id) if isinstance(user_id, str) else user_id


def frame_key(user: Column) -> Column:
    """Content key of a frame: the same user's same image at the same instant is the same frame."""
    return surrogate_key(F.col("timestamp"), F.sha2(F.col("image_data"), 256), F.coalesce(user.cast("string"), F.lit("")))


def process_frames(df: DataFrame, estimator_factory: Callable[[], Estimator],
                   user_id: Column | str | None = None, partitions: int | None = None,
                   dedup_watermark: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Messages (``value`` BINARY, or already ``timestamp, image_data``) ->
    (analysed frames, quarantined rows).

    ``dedup_watermark`` drops redelivered frames (same content key) before the
    model runs; on a stream the dedup state is bounded by the watermark.
    """
    if "value" in df.columns and "image_data" not in df.columns:
        df = decode_messages(df)
    good, bad = split_valid(df)
    uid = _user(user_id)
    good = good.drop("raw").withColumns({"frame_key": frame_key(uid), "user_id": uid})
    if dedup_watermark:
        good = dedup_frames(good, dedup_watermark)
    good = infer_landmarks(good, estimator_factory, image="image", out="lm", partitions=partitions)
    return analyze(with_landmarks(good)), bad


def landed_to_frames(landed: DataFrame, user_id: Column | str | None = None,
                     estimator_factory: Callable[[], Estimator] | None = None) -> DataFrame:
    """Landing documents -> analysed-frame shape, reusing the stored result.

    Landmarks come from the document's ``lm``; documents without them are
    re-inferred only when an estimator is given (the original daily job's
    second pass), otherwise their landmarks stay NULL.
    """
    if "lm" not in landed.columns:
        landed = landed.withColumn("lm", F.lit(None).cast("array<double>"))
    good, _ = split_valid(landed if "json_ok" in landed.columns else landed.withColumn("json_ok", F.lit(True)))
    good = good.drop("raw")
    uid = _user(user_id)
    frames = good.select("*", "analysis_result.*", frame_key(uid).alias("frame_key"), uid.alias("user_id"))
    if estimator_factory is not None:
        missing = frames.filter(F.col("lm").isNull()).drop("lm")
        redo = infer_landmarks(missing, estimator_factory, image="image", out="lm")
        frames = frames.filter(F.col("lm").isNotNull()).unionByName(redo)
    return with_landmarks(frames)


def load_frames(analyzed: DataFrame, base: str, tz: str = DEFAULT_TZ,
                concurrent: bool = True) -> dict[str, DataFrame]:
    """Write facts, images and dimension upserts for a set of analysed frames.

    The same function serves the batch job, the loader stream and the live
    stream, so batch and stream produce the same tables.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import StorageLevel, inheritable_thread_target

    # seven writes share one pass over the input and the inference stage; a
    # lost executor only recomputes its blocks (ids are deterministic)
    mine = not analyzed.is_cached  # a caller's cache may still serve its other sinks
    if mine:
        analyzed = analyzed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        analyzed.count()  # one inference pass fills the cache; the writes only read it
        facts = warehouse.to_facts(analyzed, key="frame_key", ts="event_ts", user="user_id", tz=tz,
                                   keep_landmarks="landmarks" in analyzed.columns)
        images = warehouse.to_images(analyzed, key="frame_key", ts="event_ts", image="image", tz=tz,
                                     keep_bytes=True)
        tasks = {"facts": lambda: writers.write_facts(facts, writers.table_path(base, "tb_posture")),
                 "images": lambda: writers.write_images(images, writers.table_path(base, "tb_image"), tz)}
        for name, dim in warehouse.to_dims(facts, tz).items():
            tasks[name] = (lambda n=name, d=dim: writers.append_new(
                d, writers.table_path(base, f"tb_{n}"), warehouse.DIM_KEYS[n]))
        # the writes are independent Spark jobs: submit them together so the
        # small dimension jobs overlap instead of queueing behind each other
        with ThreadPoolExecutor(max_workers=len(tasks) if concurrent else 1) as pool:
            futures = {name: pool.submit(inheritable_thread_target(fn)) for name, fn in tasks.items()}
            out = {name: f.result() for name, f in futures.items()}
    finally:
        if mine:
            analyzed.unpersist()
    return out


def start_pipeline(stream: DataFrame, out_base: str, checkpoint: str,
                   estimator_factory: Callable[[], Estimator], trigger: dict | None = None,
                   user_id: Column | str | None = None, partitions: int | None = None,
                   load_tables: bool = True, tz: str = DEFAULT_TZ,
                   dedup_watermark: str | None = None) -> StreamingQuery:
    """Live path: decode, infer, classify; per micro-batch write the result feed,
    the landing documents, the quarantine and (optionally) the warehouse tables."""

    def each(batch: DataFrame, batch_id: int) -> None:
        # the raw batch feeds the good and the quarantine paths: read it once
        batch = batch.persist()
        analyzed, bad = process_frames(batch, estimator_factory, user_id, partitions)
        analyzed = analyzed.persist()  # several sinks share one inference pass
        try:
            from concurrent.futures import ThreadPoolExecutor

            from pyspark import inheritable_thread_target

            analyzed.count()  # build the cache once, before the sinks read it concurrently

            kept = [c for c in ("file_name", "timestamp", "image_data", "reason", "raw") if c in bad.columns]
            tasks = [
                lambda: writers.write_feed(result_feed(analyzed), writers.table_path(out_base, "feed"),
                                           batch_id),
                lambda: writers.write_landing(analyzed, writers.table_path(out_base, "landing"), batch_id),
                lambda: writers.overwrite_partitions(
                    bad.select(*kept).withColumn("batch_id", F.lit(batch_id)),
                    writers.table_path(out_base, "quarantine"), ["batch_id"]),
            ]
            if load_tables:
                tasks.append(lambda: load_frames(analyzed, out_base, tz))
            # independent sinks over the persisted batch: run them as concurrent jobs
            with ThreadPoolExecutor(max_workers=len(tasks)) as pool:
                for f in [pool.submit(inheritable_thread_target(t)) for t in tasks]:
                    f.result()
        finally:
            analyzed.unpersist()
            batch.unpersist()

    # live counters per micro-batch, reported in StreamingQueryProgress.observedMetrics
    stream = stream.observe("ingest", F.count(F.lit(1)).alias("n_messages"))
    if dedup_watermark:
        # redelivered frames are dropped across micro-batches (watermark-bounded state);
        # rows that cannot be decoded share no key, so each of them goes on to the quarantine
        if "value" in stream.columns and "image_data" not in stream.columns:
            stream = decode_messages(stream)
        instant = parse_message_ts("timestamp")
        known = instant.isNotNull() & F.col("image_data").isNotNull()
        key = F.when(known, frame_key(_user(user_id))).otherwise(F.expr("uuid()"))
        stream = (stream.withColumns({"event_ts": instant, "frame_key": key})
                  .withWatermark("event_ts", dedup_watermark)
                  .dropDuplicatesWithinWatermark(["frame_key"])
                  .drop("event_ts", "frame_key"))
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"processingTime": "500 milliseconds"}))
    return w.start()


def start_landing_sink(analyzed: DataFrame, path: str, checkpoint: str,
                       trigger: dict | None = None) -> StreamingQuery:
    """Landing documents through the streaming JSON file sink: exactly-once via
    the sink's commit log (readers of ``path`` see only committed files)."""
    lm = F.col("lm") if "lm" in analyzed.columns else F.lit(None).cast("array<double>")
    doc = analyzed.select("image_data", "timestamp",
                          F.struct("cva_left", "cva_right", "fha_left", "fha_right",
                                   "posture_correct").alias("analysis_result"), lm.alias("lm"))
    w = doc.writeStream.format("json").option("ignoreNullFields", "false").option("checkpointLocation", checkpoint)
    if trigger:
        w = w.trigger(**trigger)
    return w.start(path)


def start_archive(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                  tz: str = DEFAULT_TZ) -> StreamingQuery:
    """Archive of the messages as a running job: JSON lines under ``ingest_date=<yyyyMMdd>``
    through the streaming file sink.  Its commit log names the files of each batch, so a batch
    that is replayed after a crash adds nothing, and readers of ``path`` see whole batches only.
    Messages that cannot be decoded are archived too, with their text in ``raw``."""
    if "value" in stream.columns and "image_data" not in stream.columns:
        stream = decode_messages(stream)
    rows = archive_rows(stream.withColumn("event_ts", parse_message_ts("timestamp")), "event_ts", tz)
    w = (rows.writeStream.format("json").option("ignoreNullFields", "false")
         .option("checkpointLocation", checkpoint).partitionBy("ingest_date"))
    return w.trigger(**(trigger or {"processingTime": "500 milliseconds"})).start(path)


def start_loader(landed_stream: DataFrame, out_base: str, checkpoint: str,
                 trigger: dict | None = None, user_id: Column | str | None = None,
                 tz: str = DEFAULT_TZ, estimator_factory: Callable[[], Estimator] | None = None
                 ) -> StreamingQuery:
    """Landing-zone loader: landed documents -> facts, images and dimensions; documents
    that cannot be decoded go to the quarantine with their raw text."""

    def each(batch: DataFrame, batch_id: int) -> None:
        _, bad = split_valid(batch)
        kept = [c for c in ("file_name", "timestamp", "reason", "raw") if c in bad.columns]
        (bad.select(*kept).write.mode("overwrite")  # a replayed batch overwrites itself
         .parquet(f"{writers.table_path(out_base, 'loader_quarantine')}/batch_id={batch_id}"))
        load_frames(landed_to_frames(batch, user_id, estimator_factory), out_base, tz)

    w = landed_stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"processingTime": "3 seconds"}))
    return w.start()


def live_status_rows(analyzed: DataFrame) -> DataFrame:
    """Newest result per user and its last label (one aggregation; on a stream, one state row per user)."""
    a = analyzed.withColumn("status_label", status_ops.status_label("posture_correct"))
    order = F.struct(F.col("event_ts"), F.col("frame_key"))
    agg = a.groupBy("user_id").agg(
        F.max_by(F.struct("event_ts", "cva_left", "cva_right", "fha_left", "fha_right",
                          "posture_correct"), order).alias("latest"),
        F.max_by(F.col("status_label"), F.when(F.col("status_label").isNotNull(), order)).alias("status"))
    return agg.select("user_id", "latest.*", "status")


def live_status_stream(analyzed: DataFrame, checkpoint: str, query_name: str = "live_status",
                       sink: str = "memory", trigger: dict | None = None) -> StreamingQuery:
    """Newest result per user in the driver's memory sink, to look at (``start_live_status`` writes a table)."""
    w = (live_status_rows(analyzed).writeStream.outputMode("complete" if sink == "memory" else "update")
         .format(sink).option("checkpointLocation", checkpoint))
    if sink == "memory":
        w = w.queryName(query_name)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


STATUS_KEYS = ["user_id"]
COUNT_KEYS = ["day_value", "posture_correct"]


def start_live_status(stream: DataFrame, path: str, checkpoint: str, estimator_factory: Callable[[], Estimator],
                      trigger: dict | None = None, user_id: Column | str | None = None,
                      partitions: int | None = None, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Live status as a running job: frames -> newest result per user, in a table
    (``upserts.read_upserts``).  State is one row per user, kept with the checkpoint."""
    analyzed, _ = process_frames(stream, estimator_factory, user_id, partitions)
    return start_upserts(live_status_rows(analyzed), path, STATUS_KEYS, checkpoint, trigger, compact_every)


def daily_count_rows(analyzed: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Frames with a pose per local day and class."""
    day = F.date_format(local_time("event_ts", tz), "yyyy-MM-dd")
    return (analyzed.filter(F.col("posture_correct").isNotNull())
            .groupBy(day.alias("day_value"), "posture_correct").agg(F.count(F.lit(1)).alias("cnt")))


def start_daily_counts(stream: DataFrame, path: str, checkpoint: str, estimator_factory: Callable[[], Estimator],
                       trigger: dict | None = None, user_id: Column | str | None = None,
                       partitions: int | None = None, tz: str = DEFAULT_TZ, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Counts per local day and class as a running table: the open day too, any zone, late frames
    counted however late (the state is two rows per day, so no watermark has to bound it)."""
    analyzed, _ = process_frames(stream, estimator_factory, user_id, partitions)
    return start_upserts(daily_count_rows(analyzed, tz), path, COUNT_KEYS, checkpoint, trigger, compact_every)


def daily_counts_stream(analyzed: DataFrame, checkpoint: str, query_name: str = "daily_counts",
                        watermark: str = "1 hour", start_time: str = "15 hours",
                        trigger: dict | None = None) -> StreamingQuery:
    """Per local day and class frame counts, finalised once the watermark passes
    the day (append mode, bounded state), in the driver's memory sink, to look at
    (``start_daily_counts`` writes a table, open day included). Extension."""
    # a local day in ``tz`` is a UTC window shifted by the zone offset (KST: 15:00 UTC)
    a = analyzed.withWatermark("event_ts", watermark).filter(F.col("posture_correct").isNotNull())
    agg = (a.groupBy(F.window("event_ts", "1 day", startTime=start_time).alias("day"),
                     "posture_correct").agg(F.count(F.lit(1)).alias("cnt")))
    w = (agg.writeStream.outputMode("append").format("memory").queryName(query_name)
         .option("checkpointLocation", checkpoint))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def dedup_frames(stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Drop redelivered frames (same content key) within the watermark. Extension."""
    return (stream.withWatermark("event_ts", watermark)
            .dropDuplicatesWithinWatermark(["frame_key"]))
