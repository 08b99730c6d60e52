import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vertebra.functions.geometry import angle3d, point
from vertebra.functions.numeric import round_half_even
from vertebra.operators.posture import analyze, with_landmarks


def arc_angle(p, vertex, q):
    """Unrounded degrees at ``vertex`` from the arc tangent of |u x v| over u.v; None
    without two arms."""
    u, v = (np.subtract(x, vertex) for x in (p, q))
    if not u.any() or not v.any():
        return None
    return math.degrees(math.atan2(np.sqrt((np.cross(u, v) ** 2).sum()), float(u @ v)))


def lm_rows(spark, rows):
    df = spark.createDataFrame(rows, "id int, lm array<double>")
    return {r.id: r for r in analyze(with_landmarks(df)).collect()}


def test_zero_length_arm_gives_null_angles_and_false(spark):
    # both ears exactly at the shoulder midpoint
    lm = [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.5, 0.0, 0.0]
    r = lm_rows(spark, [(1, lm)])[1]
    assert r.cva_left is None and r.fha_right is None
    assert r.posture_correct is False


def test_nan_coordinate_never_passes(spark):
    lm = [float("nan")] + [0.1] * 11
    r = lm_rows(spark, [(1, lm)])[1]
    assert r.posture_correct is False


def test_no_pose_is_null(spark):
    r = lm_rows(spark, [(1, None)])[1]
    assert r.cva_left is None and r.posture_correct is None


def test_threshold_uses_rounded_angle(spark):
    df = spark.createDataFrame([(49.996,), (49.994,), (3.125,), (142.515,)], "v double")
    got = [r[0] for r in df.select(round_half_even("v", 2)).collect()]
    assert got == [50.0, 49.99, 3.12, round(np.float64(142.515), 2)]


def test_fixture_event_one_angles(spark):
    from vertebra.plans.catalog import analyzed
    r = analyzed(spark, "/root/testdata/sf0.001").filter("event_id = 1").collect()[0]
    assert (r.cva_left, r.cva_right, r.fha_left, r.fha_right, r.posture_correct) == \
        (137.76, 46.48, 88.7, 136.47, True)


def test_fixture_class_counts(spark):
    from vertebra.plans.catalog import analyzed
    rows = analyzed(spark, "/root/testdata/sf0.01").groupBy("posture_correct").count().collect()
    got = {r[0]: r[1] for r in rows}
    assert got == {True: 6128, False: 1858, None: 2014}


coord = st.floats(min_value=-2, max_value=2, allow_nan=False)


@settings(max_examples=25, deadline=None)
@given(st.lists(coord, min_size=9, max_size=9))
def test_angle_matches_numpy_and_range(spark, v):
    a, b, c = v[0:3], v[3:6], v[6:9]
    df = spark.range(1).select(angle3d(point(*[F.lit(x) for x in a]), point(*[F.lit(x) for x in b]),
                                       point(*[F.lit(x) for x in c])).alias("ang"))
    got = df.collect()[0].ang
    exp = arc_angle(a, b, c)
    tiny = min(np.abs(np.subtract(x, b)).max() for x in (a, c)) < 1e-6
    # half a unit of the second decimal, and the arc cosine's loss near 0 and 180 degrees
    if not tiny:
        assert got is not None and abs(got - exp) <= 0.00501


def test_hand_computed_angles(spark):
    arms = {0: (2, 0, 0), 30: (math.sqrt(3), 1, 0), 45: (0, 1, 1), 60: (1, 0, math.sqrt(3)), 90: (0, 0, 5), 135: (-1, 1, 0), 180: (-3, 0, 0)}
    for degrees, arm in arms.items():
        first = (0.0, 1.0, 0.0) if degrees == 45 else (1.0, 0.0, 0.0)
        got = spark.range(1).select(angle3d(point(*[F.lit(x) for x in first]), point(*[F.lit(0.0)] * 3),
                                            point(*[F.lit(float(x)) for x in arm])).alias("ang")).collect()[0].ang
        assert got == degrees


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(coord, min_size=12, max_size=12), min_size=1, max_size=20))
def test_staged_form_equals_three_point_form(spark, rows):
    from vertebra.functions.geometry import cva, fha, midpoint
    df = with_landmarks(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, lm array<double>"))
    lmk = F.col("landmarks")
    c7 = midpoint(lmk["ls"], lmk["rs"])
    ref = df.select("id", cva(lmk["le"], c7).alias("a"), cva(lmk["re"], c7).alias("b"),
                    fha(lmk["le"], c7).alias("c"), fha(lmk["re"], c7).alias("d"))
    got = analyze(df).select("id", F.col("cva_left").alias("a"), F.col("cva_right").alias("b"),
                             F.col("fha_left").alias("c"), F.col("fha_right").alias("d"))
    norm = lambda rs: sorted((r.id, *[None if v is None else ("nan" if math.isnan(v) else v)
                                     for v in (r.a, r.b, r.c, r.d)]) for r in rs)
    assert norm(got.collect()) == norm(ref.collect())
