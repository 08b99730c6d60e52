"""Table, blob, landing, feed and archive writers.

Writers are idempotent under re-execution (partition overwrite for derived tables, key
anti-joins for append-only tables), but for ``append``, ``archive_frames`` and
``write_landing`` / ``write_feed`` without ``batch_id``, which add what they are given.  Errors fail the job
instead of being printed and dropped.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeparts import DEFAULT_TZ
from ..operators.codec_ops import archive_rows
from ..operators.warehouse import anti_join
from ..sources.tables import exists, remove
from .keys import append_indexed

FACT_PARTITIONS = ["year_id", "month_id"]


def _exists(df: DataFrame, path: str) -> bool:
    return exists(df.sparkSession, path)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Plain set-wise append (the caller guarantees the rows are new)."""
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str], fmt: str = "parquet") -> None:
    """Replace exactly the partitions present in ``df`` (dynamic overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .option("ignoreNullFields", "false")  # JSON documents keep all their keys
       .format(fmt).partitionBy(*partition_by).save(path))


def append_new(df: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Append rows whose key is not stored yet, each key once (a NULL key is a key); returns what was added.

    When the table is partitioned, only the partitions the new rows touch are
    read for the key check (static partition filter).
    """
    fresh = df.dropDuplicates(keys)
    if _exists(df, path):
        existing = df.sparkSession.read.format(fmt).load(path)
        if partition_by:
            # read only the partitions this batch touches: its distinct partition
            # values (calendar months for facts) are a short list, applied as a
            # static filter so the scan prunes every other partition
            touched = [tuple(r) for r in fresh.select(*partition_by).distinct().collect()]
            if not touched:
                return fresh
            cond = None
            for vals in touched:
                c = None
                for col, v in zip(partition_by, vals):
                    e = F.col(col).isNull() if v is None else (F.col(col) == F.lit(v))
                    c = e if c is None else c & e
                cond = c if cond is None else cond | c
            existing = existing.filter(cond)
        jk = list(dict.fromkeys((partition_by or []) + keys))
        fresh = anti_join(fresh, existing, jk)
    # the existing side's file list is fixed when it is read above, so the
    # append below cannot feed back into the anti-join (also on re-execution)
    append(fresh, path, partition_by, fmt)
    return fresh


def write_facts(facts: DataFrame, path: str) -> None:
    """Fact rows, once per ``posture_id``, partitioned by year and month; a batch is
    held against the stored keys of its own hours only."""
    append_indexed(facts, path, ["posture_id"], "timestamp", FACT_PARTITIONS)


def write_images(images: DataFrame, path: str, tz: str = DEFAULT_TZ) -> None:
    """Image blobs keyed by ``img_filename`` (bytes stay out of the fact table and
    out of the key check), partitioned by local capture year and month like the facts."""
    local = F.from_utc_timestamp(F.col("capture_time"), tz)
    parts = images.withColumns({"year_id": F.year(local), "month_id": F.month(local)})
    append_indexed(parts, path, ["img_filename"], "capture_time", FACT_PARTITIONS)


def write_daily_stat(mart: DataFrame, path: str, day: dt.date | None = None) -> None:
    """Daily mart rows; re-running a day replaces that day instead of duplicating it.  With
    ``day``, the one day of ``mart``, a day left without frames loses its stored rows too."""
    if day is not None and mart.isEmpty():
        remove(mart.sparkSession, f"{path}/year_id={day.year}/month_id={day.month}/day_id={day.day}")
        return
    overwrite_partitions(mart, path, ["year_id", "month_id", "day_id"])


def write_landing(analyzed: DataFrame, path: str, batch_id: int | None = None,
                  image: str = "image_data", ts: str = "timestamp") -> None:
    """Landing documents ``{image_data, timestamp, analysis_result}`` as JSON lines.

    With ``batch_id`` the output goes to ``batch_id=<n>`` and a replayed micro-batch
    overwrites its own folder.
    """
    lm = F.col("lm") if "lm" in analyzed.columns else F.lit(None).cast("array<double>")
    doc = analyzed.select(F.col(image).alias("image_data"), F.col(ts).alias("timestamp"),
                          F.struct("cva_left", "cva_right", "fha_left", "fha_right",
                                   "posture_correct").alias("analysis_result"),
                          lm.alias("lm"))
    if batch_id is None:
        doc.write.mode("append").option("ignoreNullFields", "false").json(path)
    else:
        overwrite_partitions(doc.withColumn("batch_id", F.lit(batch_id)), path, ["batch_id"], "json")


def write_feed(feed: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Result feed values (JSON text per frame), one folder per micro-batch."""
    out = feed.select("value")
    if batch_id is None:
        out.write.mode("append").text(path)
    else:
        overwrite_partitions(out.withColumn("batch_id", F.lit(batch_id)), path, ["batch_id"], "text")


def archive_frames(messages: DataFrame, path: str, ts: str = "event_ts", tz: str = DEFAULT_TZ) -> None:
    """Raw messages under ``ingest_date=<yyyyMMdd>`` folders (local day of the frame).

    Spark writes part files, not one file per message; each archived row keeps
    the per-message name (``kafka_<timestamp>.json``) as ``archive_name``.
    A second call adds its rows again; ``streaming.jobs.start_archive`` adds none twice.
    """
    archive_rows(messages, ts, tz).write.mode("append").partitionBy("ingest_date").json(path)


def table_path(base: str, name: str) -> str:
    return os.path.join(base, name)
