"""Append-only tables with a key index: each key once, at the price of a batch's own hours.

Beside a table ``t`` lies ``t__keys``, which holds nothing but its keys, in one folder per hour
of the row's instant.  A key fixes its instant (ids are content hashes that include it), so a
batch is held against the folders of its own hours, however long the table is, and of the batch
only the keys are shuffled: the rows, with their image bytes, go from the input to the writer
through a broadcast filter on the few keys that must not pass as they are.

A batch is announced in ``t__pending`` before the table is written and struck off after the
index was.  What a broken run left there is settled by the next: those of its keys that did
reach the table join the index.  So a replayed batch adds exactly what is missing.  One writer
at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.warehouse import anti_join, same_keys
from ..sources.tables import children, exists, remove

HOUR = "_hour"
NO_HOUR = -1_000_000  # rows without an instant
HOUR_US = 3_600_000_000
# keys at most that are broadcast as a filter (about 100 bytes each)
BROADCAST_KEYS = 200_000
# hours at most that a batch lists one by one; one that spans more reads the range between
LISTED_HOURS = 1_000


def index_path(path: str) -> str:
    return path.rstrip("/") + "__keys"


def pending_path(path: str) -> str:
    return path.rstrip("/") + "__pending"


def hour_of(instant: str) -> Column:
    """Hours since the epoch (no time zone enters)."""
    us = F.unix_micros(F.col(instant).cast("timestamp"))
    return F.coalesce(F.floor(us / F.lit(HOUR_US)).cast("int"), F.lit(NO_HOUR)).alias(HOUR)


def _index(spark: SparkSession, path: str, like: DataFrame, keys: list[str], hours: list[int]) -> DataFrame:
    """The stored keys of ``hours``: a static filter on the index's folders."""
    if not exists(spark, index_path(path)):
        return like.select(*keys, HOUR).limit(0)
    schema = like.select(*keys, HOUR).schema
    stored = spark.read.schema(schema).parquet(index_path(path))
    if len(hours) <= LISTED_HOURS:
        return stored.where(F.col(HOUR).isin(hours))
    return stored.where(F.col(HOUR).between(min(hours), max(hours)))


def _hours(keyed: DataFrame) -> list[int]:
    # as many as hours passed in the batch's data: a calendar bound, not a row count
    return sorted(r[0] for r in keyed.select(HOUR).distinct().collect())


def _add(keyed: DataFrame, path: str, keys: list[str]) -> None:
    keyed.select(*keys, HOUR).write.mode("append").partitionBy(HOUR).parquet(index_path(path))


def settle(spark: SparkSession, path: str, keys: list[str], instant: str) -> None:
    """Bring the index up to the table: index a table that has none, and finish or strike off
    the batches of broken runs."""
    there = exists(spark, path)
    if there and not exists(spark, index_path(path)) and not exists(spark, pending_path(path)):
        _add(spark.read.parquet(path).select(*keys, hour_of(instant)).distinct(), path, keys)
    for token in children(spark, pending_path(path)):
        if there and exists(spark, f"{token}/_SUCCESS"):
            batch = spark.read.parquet(token).where("NOT _stored")
            hours = _hours(batch)
            if hours:
                table = spark.read.parquet(path)
                span = F.col(instant).isNull() if hours[0] == NO_HOUR else F.lit(False)
                span = span | F.unix_micros(F.col(instant).cast("timestamp")).between(hours[0] * HOUR_US, (hours[-1] + 1) * HOUR_US)
                arrived = table.where(span).select(*keys).distinct()
                arrived = batch.join(arrived, same_keys(batch, arrived, keys), "left_semi")
                _add(anti_join(arrived, _index(spark, path, batch, keys, hours), [*keys, HOUR]), path, keys)
        remove(spark, token)


def mark(rows: DataFrame, path: str, keys: list[str], instant: str) -> DataFrame:
    """The batch's keys, once each: keys, _hour, _copies (rows that have it) and _stored."""
    batch = rows.select(*keys, hour_of(instant)).groupBy(*keys, HOUR).agg(F.count(F.lit(1)).alias("_copies"))
    stored = _index(rows.sparkSession, path, batch, keys, _hours(batch))
    stored = stored.select(*[F.col(k).alias(f"_stored_{k}") for k in [*keys, HOUR]], F.lit(True).alias("_there"))
    same = F.lit(True)
    for k in [*keys, HOUR]:
        same = same & batch[k].eqNullSafe(stored[f"_stored_{k}"])
    return batch.join(stored, same, "left").select(*keys, HOUR, "_copies", F.coalesce("_there", F.lit(False)).alias("_stored"))


def _small(keys: DataFrame, n: int) -> DataFrame:
    return F.broadcast(keys) if n <= BROADCAST_KEYS else keys


def unstored(rows: DataFrame, marked: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``rows`` to append, each new key once (``marked``: a written ``mark``).

    Keys that are new and have one row pass a filter: the smaller of "not these" and "these" is
    broadcast if it is small enough, else the join shuffles.  Only rows whose new key is there
    several times (redelivered within the batch) are shuffled to keep one.
    """
    once, many, skip = marked.where("NOT _stored AND _copies = 1"), marked.where("NOT _stored AND _copies > 1"), marked.where("_stored OR _copies > 1")
    n = marked.agg(F.count_if(F.expr("NOT _stored AND _copies = 1")), F.count_if(F.expr("NOT _stored AND _copies > 1")),
                   F.count_if(F.expr("_stored OR _copies > 1"))).first()
    if n[2] <= BROADCAST_KEYS or n[2] <= n[0]:
        out = rows if not n[2] else rows.join(_small(skip, n[2]).select(*keys), same_keys(rows, skip, keys), "left_anti")
    else:
        out = rows.join(_small(once, n[0]).select(*keys), same_keys(rows, once, keys), "left_semi")
    if n[1]:
        again = rows.join(_small(many, n[1]).select(*keys), same_keys(rows, many, keys), "left_semi")
        out = out.unionByName(again.dropDuplicates(keys))
    return out


def append_indexed(rows: DataFrame, path: str, keys: list[str], instant: str, partition_by: list[str] | None = None) -> None:
    """Append the rows whose key is not in the table yet, each key once (NULL is a key)."""
    spark = rows.sparkSession
    settle(spark, path, keys, instant)
    token = f"{pending_path(path)}/{uuid.uuid4().hex}"
    mark(rows, path, keys, instant).write.parquet(token)
    marked = spark.read.parquet(token)
    fresh = marked.where("NOT _stored")
    if not fresh.isEmpty():
        write = unstored(rows, marked, keys).write.mode("append")
        (write.partitionBy(*partition_by) if partition_by else write).parquet(path)
        _add(fresh, path, keys)
    remove(spark, token)
