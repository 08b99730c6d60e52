"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Characters (code units of Arrow text) that one Python work unit handles at once.
UNIT_CHARS = 1_500_000
#: Rows and bytes of an Arrow batch at most: rows carry whole texts, and a batch exists
#: twice outside the Java heap.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a folder, through Spark's reader only (any URI).

    Also lowers the session's Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES`` (a larger
    one is a matter of memory only, never of results) and leaves it so: the caller runs the
    plan later.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder (``spark.checkpoint.dir``) and reread it.

    Cuts the lineage: a lost executor never repeats what came before.  The files belong
    to the run and go with the shared folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_fold(ident: Column, mod: int, remainder: int) -> Column:
    """crc32 of the id's decimal text modulo ``mod`` equals ``remainder`` (null id: false)."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % mod == remainder, F.lit(False))


def spread(df: DataFrame, spark: SparkSession | None = None) -> int:
    """Number of shuffle partitions of the session, for explicit repartitions."""
    return int((spark or df.sparkSession).conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give freed memory back to the system: workers are kept, and so is what their pools hold."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


_HELD: dict[str, dict] = {}


def held(owner: str) -> dict:
    """What this Python worker keeps from task to task for ``owner``.

    A worker is reused by whatever runs next in the session, so what it kept for another
    owner is let go.  It only saves time: an owner finds it again or makes it anew.
    """
    if owner not in _HELD:
        _HELD.clear()
        _HELD[owner] = {}
        release()
    return _HELD[owner]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = UNIT_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut Arrow batches so that one piece holds about ``most`` bytes of text (one row at
    least), whatever the size of the incoming batch; texts as Python strings."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        start, n = 0, batch.num_rows
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(False)
        while start < n:
            end, total = start, 0
            while end < n and (end == start or total + lengths[end] <= most):
                total += lengths[end]
                end += 1
            part = batch.slice(start, end - start)
            yield part, part.column(at).to_pylist()
            start = end
        del batch
        release()


def heaviest(df: DataFrame, weight: str, most: int, key: str) -> DataFrame:
    """The rows of largest ``weight`` (positive), about ``most`` of them if there are more.

    Weights are compared by step (a sixteenth of a doubling), so no task sends more than its
    own share.  The step that the bound falls into is thinned by a hash of ``key``: of rows of
    equal weight some stay, never none, and the same ones in every run.
    """
    step = F.floor(F.log2(F.col(weight)) * 16)
    steps = sorted(((r["s"], r["n"]) for r in df.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total = 0
    for s, n in steps:
        if total + n > most:
            draw = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
            return df.where((step > s) | ((step == s) & (draw < (most - total) / n)))
        total += n
    return df
