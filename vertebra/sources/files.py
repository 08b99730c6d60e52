"""File sources: one multi-line JSON object per file, image blobs, landing zone."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import file_basename
from ..schemas import FRAME_MESSAGE, LANDED_DOCUMENT


def _checked(reader, schema: T.StructType, path: str) -> DataFrame:
    """The JSON records of ``path`` with ``file_name``, ``json_ok`` and, for a malformed
    record, its ``raw`` text: nothing malformed passes for a record of NULLs.  (Spark wants
    a query to read one data column beside these.)"""
    df = (reader.schema(schema.add("_corrupt", "string") if "_corrupt" not in schema.names else schema)
          .option("columnNameOfCorruptRecord", "_corrupt").json(path))
    return (df.withColumn("file_name", F.col("_metadata.file_path"))
            .withColumn("json_ok", F.col("_corrupt").isNull()).withColumnRenamed("_corrupt", "raw"))


def read_frames(spark: SparkSession, path: str, schema: T.StructType = FRAME_MESSAGE) -> DataFrame:
    """Batch scan of ``*.json`` frame files with lineage (``_checked``)."""
    reader = (spark.read.option("multiLine", True)
              .option("pathGlobFilter", "*.json").option("recursiveFileLookup", True))
    return _checked(reader, T.StructType(list(schema.fields)), path)


# files at most whose paths are named one by one to a scan (a path is about 200 bytes); the driver
# holds as much for every file of a folder that it lists
NAMED_FILES = 50_000


def wanted_paths(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """Paths under ``path`` whose file name is in ``names`` (img_filename), by the listing
    alone: the scan has no content column, so no file is opened."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
              .select("path", file_basename("path").alias("img_filename")))
    return listed.join(names.select("img_filename"), "img_filename", "left_semi").select("path")


def read_images(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """Image blobs as ``img_filename, image BINARY, file_size`` (binaryFile source).

    With ``names`` (img_filename) only the files so named, and up to ``NAMED_FILES`` of them
    only those are opened: their paths are found first and become the scan's own.  Beyond,
    the whole folder is read and cut by the same semi-join.
    """
    some = None
    if names is not None:
        some = [r["path"] for r in wanted_paths(spark, path, names).limit(NAMED_FILES + 1).collect()]
        # a path is taken for a pattern by the reader
        some = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in some] if len(some) <= NAMED_FILES else None
    blobs = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(some or path)
    out = blobs.select(file_basename("path").alias("img_filename"),
                       F.col("content").alias("image"),
                       F.col("length").cast("int").alias("file_size"))
    if some == []:
        return out.where(F.lit(False))
    return out if names is None or some else out.join(names.select("img_filename"), "img_filename", "left_semi")


def landing_stream(spark: SparkSession, path: str, schema: T.StructType = LANDED_DOCUMENT,
                   max_files_per_trigger: int | None = None,
                   clean_source: str | None = None, archive_dir: str | None = None,
                   multi_line: bool = False) -> DataFrame:
    """Streaming scan of landed JSON documents (the polling loader's input).

    ``multi_line`` for one indented object per file; the live job writes JSON lines.
    """
    r = (spark.readStream.option("multiLine", multi_line)
         .option("pathGlobFilter", "*.json").option("recursiveFileLookup", True))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if clean_source:
        r = r.option("cleanSource", clean_source)
        if archive_dir:
            r = r.option("sourceArchiveDir", archive_dir)
    return _checked(r, T.StructType(list(schema.fields)), path)


def frame_file_stream(spark: SparkSession, path: str, schema: T.StructType = FRAME_MESSAGE,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of frame JSON files (a file stand-in for the broker)."""
    r = spark.readStream.option("multiLine", True).option("pathGlobFilter", "*.json")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return _checked(r, T.StructType(list(schema.fields)), path)
