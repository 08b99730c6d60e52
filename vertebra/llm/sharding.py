"""Sharding of indivisible groups by Karmarkar-Karp differencing.

A *partial partition* is one load per shard.  The two partials of the largest spread are
combined again and again, one in descending and one in ascending order of load, until one
is left.  Documents of equal text form a group that is never divided.

At scale the groups are dealt to chunks by hash, and each chunk is differenced in a task
of its own.  Groups larger than ``1 / (n_shards * BIG)`` of all bytes are differenced
first (there are at most ``n_shards * BIG`` of them, so they fit the driver); each chunk
starts from their loads, scaled to its share of the small groups' bytes, as one more
partial partition.  So every chunk counterbalances the large groups by its share, and the
chunks' own spreads (a few bytes) are all that is left.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

BIG = 256


def difference(sizes: Sequence[int], n_shards: int, ballast: Sequence[int] | None = None) -> np.ndarray:
    """Shard of each size.  ``ballast``: loads the shards have already (all 0 if None).

    Ties go to the item that comes first, so the result depends on the order of sizes.
    """
    k = n_shards
    base = list(ballast) if ballast is not None else [0] * k
    # a partial is a list of (load, slot) by descending load; slots number its own subsets
    order = sorted(range(k), key=lambda j: -base[j])
    low = base[order[-1]]
    partials: dict[int, list[tuple[int, int]]] = {0: [(base[j] - low, j) for j in order]}
    rest = [(0, j) for j in range(1, k)]
    for i, s in enumerate(sizes, 1):
        partials[i] = [(int(s), 0), *rest]
    heap = [(-p[0][0], i) for i, p in partials.items()]
    heapq.heapify(heap)
    n = len(sizes) + 1
    made: list[tuple[int, int, bytes, bytes]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        pa_, pb = partials.pop(a), partials.pop(b)
        both = [(x + y, i, j) for (x, i), (y, j) in zip(pa_, reversed(pb))]
        both.sort(key=lambda t: -t[0])
        low = both[-1][0]
        new = n + len(made)
        partials[new] = [(x - low, s) for s, (x, _, _) in enumerate(both)]
        made.append((a, b, bytes(i for _, i, _ in both), bytes(j for _, _, j in both)))
        heapq.heappush(heap, (-partials[new][0][0], new))
    labels: dict[int, list[int]] = {heap[0][1]: list(range(k))}
    for new in range(n + len(made) - 1, n - 1, -1):
        a, b, left, right = made[new - n]
        own = labels.pop(new)
        for child, slots in ((a, left), (b, right)):
            out = [0] * k
            for label, slot in zip(own, slots):
                out[slot] = label
            labels[child] = out
    shard = [0] * k
    for j, label in enumerate(labels[0]):
        shard[label] = j
    return np.array([shard[labels[i][0]] for i in range(1, n)], dtype=np.int32)


def _difference_chunk(loads: list[int], small: int, n_shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "grp"], ascending=[False, True])
        part = int(pdf["bytes"].sum())
        ballast = [x * part // max(small, 1) for x in loads]
        return pd.DataFrame({"grp": pdf["grp"].to_numpy(),
                             "shard": difference(pdf["bytes"].tolist(), n_shards, ballast)})

    return run


def kk_shards(docs: DataFrame, n_shards: int = 24, chunk_groups: int = 8192,
              bucket_rows: int = 4096) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text) into one of ``n_shards`` shards of nearly
    equal bytes; rows of equal text share a shard.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot (gapless
    from 0 in each shard).  A null text has no bytes (crc32 0) and null texts form one
    group; null and repeated doc_ids are rows like others; other columns are not read; an
    empty table gives no rows.  Groups are keyed by a 64-bit hash: a collision merges two
    groups, which still keeps equal texts together.
    """
    rows = stash(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).alias("grp")), "shard-rows")
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    total, n_rows, n_groups = groups.agg(
        F.sum("bytes"), F.lit(0), F.count("*")).first()
    n_rows, total = rows.count(), total or 0
    bound = max(total // (n_shards * BIG), 1)
    big = groups.where(F.col("bytes") > bound).orderBy(F.desc("bytes"), "grp").collect()  # at most n_shards * BIG
    of_big = difference([r["bytes"] for r in big], n_shards)
    loads = [0] * n_shards
    for r, s in zip(big, of_big):
        loads[s] += r["bytes"]
    small = total - sum(loads)
    n_chunks = max(1, -(-n_groups // chunk_groups))
    placed = (groups.where(F.col("bytes") <= bound)
              .groupBy(F.pmod(F.xxhash64("grp", F.lit(7)), F.lit(n_chunks)).alias("chunk"))
              .applyInPandas(_difference_chunk(loads, small, n_shards), "grp long, shard int"))
    if big:
        spark = docs.sparkSession
        placed = placed.unionByName(spark.createDataFrame(
            [(r["grp"], int(s)) for r, s in zip(big, of_big)], "grp long, shard int"))
    n_buckets = max(1, -(-n_rows // bucket_rows))
    put = stash(rows.join(placed, "grp").select(
        "doc_id", "size", "text_crc32", "shard",
        F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_buckets)).cast("int").alias("bucket")), "shard-put")
    return _slots(put)


def _slots(put: DataFrame) -> DataFrame:
    """Gapless numbers per shard: rows are numbered in (shard, bucket), and each bucket
    starts where the one before it ends, so no task holds a whole shard."""
    w = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (put.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
              .select("shard", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start")))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (put.withColumn("nth", F.row_number().over(own) - 1).join(starts, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("start") + F.col("nth")).cast("long").alias("slot")))


def op1(docs: DataFrame) -> DataFrame:
    """The contract's rows: law ``bytes``."""
    return kk_shards(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
