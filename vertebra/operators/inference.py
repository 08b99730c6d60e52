"""Distributed pose inference behind a plug-in estimator (``mapInArrow``).

An estimator factory is called once per partition iterator inside the Python
worker (so non-serialisable clients and models are built there); the
estimator maps a list of image byte strings to a list of 12-coordinate
landmark sequences (LS, RS, LE, RE as x, y, z), or ``None`` for no pose.
Arrow batches bound the rows in flight
(``spark.sql.execution.arrow.maxRecordsPerBatch``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Estimator = Callable[[Sequence[bytes | None]], Sequence[Sequence[float] | None]]


def infer_landmarks(df: DataFrame, estimator_factory: Callable[[], Estimator],
                    image: str = "image", out: str = "lm",
                    partitions: int | None = None) -> DataFrame:
    """Add ``out array<double>`` (NULL = no pose) from the image bytes column.

    Only the image column becomes Python objects; all others, of whatever type, pass
    through as the Arrow columns they are, so nothing is converted to pandas and back.

    ``partitions`` re-spreads the rows before the Python stage when the input
    has too few partitions for the cluster (e.g. a small broker topic).
    """
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    if partitions:
        df = df.repartition(partitions)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        est = estimator_factory()
        for batch in batches:
            res = est(batch.column(batch.schema.get_field_index(image)).to_pylist())
            lm = pa.array([None if r is None else [float(v) for v in r] for r in res], pa.list_(pa.float64()))
            yield batch.append_column(out, lm)  # the other columns go on as they came

    return df.mapInArrow(run, schema)


def mediapipe_estimator_factory(model_complexity: int = 1) -> Callable[[], Estimator]:
    """Estimator backed by MediaPipe Pose + OpenCV, when those packages exist."""

    def factory() -> Estimator:
        try:
            import cv2  # type: ignore
            import mediapipe as mp  # type: ignore
            import numpy as np
        except ImportError as e:  # pragma: no cover - not installed here
            raise ImportError("MediaPipe/OpenCV are not installed; pass another estimator") from e
        pose = mp.solutions.pose.Pose(static_image_mode=True, model_complexity=model_complexity)
        idx = [mp.solutions.pose.PoseLandmark[n].value
               for n in ("LEFT_SHOULDER", "RIGHT_SHOULDER", "LEFT_EAR", "RIGHT_EAR")]

        def est(images):
            out = []
            for b in images:
                if b is None:
                    out.append(None)
                    continue
                img = cv2.imdecode(np.frombuffer(b, np.uint8), cv2.IMREAD_COLOR)
                r = None if img is None else pose.process(cv2.cvtColor(img, cv2.COLOR_BGR2RGB))
                if r is None or not r.pose_landmarks:
                    out.append(None)
                    continue
                lm = r.pose_landmarks.landmark
                out.append([c for i in idx for c in (lm[i].x, lm[i].y, lm[i].z)])
            return out

        return est

    return factory


def recorded_landmarks_factory() -> Callable[[], Estimator]:
    """Estimator for payloads that already carry landmarks as a JSON array of 12
    finite numbers (pose computed upstream, or a replay of recorded results); any
    other payload means no pose."""

    def factory() -> Estimator:
        import json
        import math

        def number(x):
            return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)

        def est(images):
            out = []
            for b in images:
                try:
                    v = json.loads(b.decode("utf-8")) if b else None
                except (UnicodeDecodeError, ValueError):
                    v = None
                ok = isinstance(v, list) and len(v) == 12 and all(map(number, v))
                out.append([float(x) for x in v] if ok else None)
            return out

        return est

    return factory
