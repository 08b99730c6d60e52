"""Ordered scans over blocks: range partitions of about equal size.

A running value over a long key (the last label so far, the row before, the rank) is found in
two passes: inside blocks of a range partition by (key, order), then across one summary row per
(block, key), whose value is carried into the block.  A range partition splits a hot key and,
by the later order columns, a hot instant: no task gets more than its share of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK = "_block"


def with_blocks(df: DataFrame, order: list[str], blocks: int | None = None) -> DataFrame:
    """``df`` range-partitioned by ``order`` (nulls first), with the partition's number as
    ``_block``: every block's rows come before those of the next.  ``blocks`` defaults to
    ``spark.sql.shuffle.partitions``.  Rows equal in all of ``order`` share a block.

    Every run of a range partition samples its bounds anew, so a plan that reads the numbers
    twice needs them written first (``fixed_blocks``, or a table)."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).withColumn(BLOCK, F.spark_partition_id())


def fixed_blocks(df: DataFrame, order: list[str], blocks: int | None = None) -> DataFrame:
    """``with_blocks``, written once to the shared checkpoint folder."""
    return cut_lineage(with_blocks(df, order, blocks))


def inside(keys: list[str], order: list[str]):
    """Window over a key's rows of one block."""
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def across(keys: list[str]):
    """Window over a key's block summaries."""
    return Window.partitionBy(*keys).orderBy(BLOCK)


def carried(keys: list[str], value: Column) -> Column:
    """The last non-null ``value`` of the blocks before (a window over summaries)."""
    return F.last(value, ignorenulls=True).over(across(keys).rowsBetween(Window.unboundedPreceding, -1))


def ranked(blocked: DataFrame, keys: list[str], order: list[str], rank: str, total: str) -> DataFrame:
    """``blocked`` (a written table with ``_block``; ``keys`` not null) without the block and with
    ``rank`` (from 0) and ``total``, the number of rows, within each key by ``order``."""
    per = blocked.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_rows"))
    before = across(keys).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, BLOCK, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
                     F.sum("_rows").over(Window.partitionBy(*keys)).alias(total))
    own = blocked.withColumn(rank, F.row_number().over(inside(keys, order)) - 1)
    return own.join(per, [*keys, BLOCK]).withColumn(rank, F.col(rank) + F.col("_before")).drop(BLOCK, "_before")
