"""Per-frame posture analysis from landmarks (geometry as Column expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import landmarks_from_array, midpoint, with_neck_metrics

RESULT_FIELDS = ("cva_left", "cva_right", "fha_left", "fha_right", "posture_correct")


def with_landmarks(df: DataFrame, lm: str = "lm", out: str = "landmarks") -> DataFrame:
    """Flat coordinate array -> landmark struct (NULL when no pose)."""
    return df.withColumn(out, landmarks_from_array(F.col(lm)))


def with_c7(df: DataFrame, landmarks: str = "landmarks") -> DataFrame:
    lmk = F.col(landmarks)
    return df.withColumn("c7", F.when(lmk.isNotNull(), midpoint(lmk["ls"], lmk["rs"])))


def analyze(df: DataFrame, landmarks: str = "landmarks") -> DataFrame:
    """Add the five analysis fields; a missing pose gives five NULLs, row kept."""
    if landmarks not in df.columns and "lm" in df.columns:
        df = with_landmarks(df, "lm", landmarks)
    return with_neck_metrics(df, landmarks)


def result_struct(prefix: str = "") -> F.Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in RESULT_FIELDS])
