"""A keyed result of a stream as a table: the newest row per key.

The stream keeps one state row per key and gives out, per micro-batch, the keys that changed
(update mode).  Each batch writes its changes to a folder of its own, which a replay of the
batch overwrites; nothing passes through the driver.  The table is the newest change per key.
Every so many batches the changes are folded into a snapshot, and what two snapshots back is
no longer needed goes, so a reader that began before still finds its files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import children, exists, remove

BATCH = "batch_id"
COMPACT_EVERY = 50


def _numbered(spark: SparkSession, folder: str) -> dict[int, str]:
    """Complete folders ``name=<n>`` by number."""
    found = {int(p.rsplit("=", 1)[1]): p for p in children(spark, folder) if "=" in p.rsplit("/", 1)[1]}
    return {n: p for n, p in sorted(found.items()) if exists(spark, f"{p}/_SUCCESS")}


def read_upserts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The newest row per key and the ``batch_id`` that wrote it; None before the first batch.

    Partial aggregation keeps one row per key and task, so a key that changes in every batch
    is no hot key."""
    snapshots = _numbered(spark, f"{path}/snapshots")
    upto = max(snapshots, default=-1)
    files = [p for n, p in _numbered(spark, f"{path}/changes").items() if n > upto]
    files += [snapshots[upto]] if upto >= 0 else []
    if not files:
        return None
    rows = spark.read.schema(spark.read.parquet(files[0]).schema).parquet(*files)
    rest = [c for c in rows.columns if c not in keys and c != BATCH]
    newest = F.max_by(F.struct(BATCH, *rest), F.col(BATCH))
    return rows.groupBy(*keys).agg(newest.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in [*rest, BATCH]])


def compact(spark: SparkSession, path: str, keys: list[str], upto: int) -> None:
    """Fold all batches to ``upto`` into a snapshot; drop what lies before the last but one."""
    rows = read_upserts(spark, path, keys)
    if rows is None:
        return
    rows.write.mode("overwrite").parquet(f"{path}/snapshots/upto={upto}")
    kept = sorted(_numbered(spark, f"{path}/snapshots"))[-2:]
    for n, p in _numbered(spark, f"{path}/snapshots").items():
        if n < kept[0]:
            remove(spark, p)
    if len(kept) == 2:
        for n, p in _numbered(spark, f"{path}/changes").items():
            if n <= kept[0]:
                remove(spark, p)


def write_changes(changed: DataFrame, batch_id: int, path: str, keys: list[str], compact_every: int = COMPACT_EVERY) -> None:
    """One micro-batch of changes; writing it again changes nothing."""
    spark = changed.sparkSession
    if max(_numbered(spark, f"{path}/snapshots"), default=-1) >= batch_id:
        return  # a replay of a batch that a snapshot already holds
    changed.withColumn(BATCH, F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/changes/{BATCH}={batch_id}")
    if (batch_id + 1) % compact_every == 0:
        compact(spark, path, keys, batch_id)


def start_upserts(grouped: DataFrame, path: str, keys: list[str], checkpoint: str, trigger: dict | None = None,
                  compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Run a streaming aggregation (one row per ``keys``) into the table at ``path``."""
    w = (grouped.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(lambda changed, n: write_changes(changed, n, path, keys, compact_every)))
    return w.trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()
