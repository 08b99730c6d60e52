"""Broker sources. Only ``value BINARY`` is used downstream, so any source that
yields it (Kafka, a file stream, a table) feeds the same decoder.

The Kafka connector jar must be on the classpath (``spark.jars.packages``);
these functions only set the options.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def kafka_options(servers: str, topic: str, starting: str = "latest",
                  group_id: str | None = None, extra: dict | None = None) -> dict:
    opts = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if group_id:
        opts["kafka.group.id"] = group_id
    opts.update(extra or {})
    return opts


def frame_stream(spark: SparkSession, servers: str, topic: str, starting: str = "latest",
                 group_id: str | None = None, max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Live frames: one topic, from ``latest`` by default (restart resumes from the checkpoint)."""
    extra = {"maxOffsetsPerTrigger": str(max_offsets_per_trigger)} if max_offsets_per_trigger else None
    return (spark.readStream.format("kafka")
            .options(**kafka_options(servers, topic, starting, group_id, extra)).load())


def replay_frames(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Bounded batch replay of the whole topic (earliest to latest offsets)."""
    opts = kafka_options(servers, topic, "earliest", extra={"endingOffsets": "latest"})
    return spark.read.format("kafka").options(**opts).load()
