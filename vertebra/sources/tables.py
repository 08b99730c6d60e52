"""Parquet table scans; Catalyst pushes filters and prunes columns at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system Spark reads is there."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system; a missing one is fine."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Paths of the folders and files in a folder of any file system; none if it is missing."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(hpath)) if fs.exists(hpath) else []


def read_table(spark: SparkSession, base: str, name: str,
               schema: T.StructType | None = None) -> DataFrame:
    """``base/name.parquet`` if it exists, else the folder ``base/name``.

    With an explicit ``schema`` no parquet footer is read to infer it.
    """
    base = base.rstrip("/")
    p = f"{base}/{name}.parquet"
    if not exists(spark, p) and exists(spark, f"{base}/{name}"):
        p = f"{base}/{name}"
    r = spark.read if schema is None else spark.read.schema(schema)
    return r.parquet(p)
