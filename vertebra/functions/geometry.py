"""Neck geometry as native Column expressions (whole-stage codegen, no UDF).

Landmarks are ``struct<ls,rs,le,re: struct<x,y,z>>``; the cervical point C7 is
approximated by the shoulder midpoint.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import round_half_even

# fixed values of the posture rule: reference thresholds (degrees), offset of the
# auxiliary point (landmark units) and angle precision (decimals)
CVA_THRESHOLD = 50.0
FHA_THRESHOLD = 80.0
AUX_OFFSET = 0.1
ANGLE_DIGITS = 2


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def point_at(arr: Column, offset: int) -> Column:
    """Point from three consecutive elements of a flat coordinate array (0-based)."""
    return point(arr[offset], arr[offset + 1], arr[offset + 2])


def landmarks_from_array(arr: Column) -> Column:
    """Flat array (LS xyz, RS xyz, LE xyz, RE xyz) -> landmark struct; NULL stays NULL."""
    s = F.struct(point_at(arr, 0).alias("ls"), point_at(arr, 3).alias("rs"),
                 point_at(arr, 6).alias("le"), point_at(arr, 9).alias("re"))
    return F.when(arr.isNotNull(), s)


def midpoint(a: Column, b: Column) -> Column:
    return point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2, (a["z"] + b["z"]) / 2)


def shifted(p: Column, dx: float = 0.0, dy: float = 0.0, dz: float = 0.0) -> Column:
    return point(p["x"] + dx if dx else p["x"], p["y"] + dy if dy else p["y"],
                 p["z"] + dz if dz else p["z"])


def angle3d(a: Column, b: Column, c: Column, digits: int = ANGLE_DIGITS) -> Column:
    """Angle at vertex ``b`` between ``a`` and ``c`` in degrees, rounded half-even.

    A zero-length arm yields NULL (``try_divide``), not NaN.
    """
    bax, bay, baz = a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"]
    bcx, bcy, bcz = c["x"] - b["x"], c["y"] - b["y"], c["z"] - b["z"]
    dot = bax * bcx + bay * bcy + baz * bcz
    n1 = F.sqrt(bax * bax + bay * bay + baz * baz)
    n2 = F.sqrt(bcx * bcx + bcy * bcy + bcz * bcz)
    cosine = F.try_divide(dot, n1 * n2)
    return round_half_even(F.degrees(F.acos(cosine)), digits)


def cva(ear: Column, c7: Column) -> Column:
    """Cranio-vertebral angle: ear - C7 - (C7 moved down the z axis)."""
    return angle3d(ear, c7, shifted(c7, dz=-AUX_OFFSET))


def fha(ear: Column, mid: Column) -> Column:
    """Forward-head angle: ear - shoulder midpoint - (midpoint moved along x)."""
    return angle3d(ear, mid, shifted(mid, dx=AUX_OFFSET))


def _at_least(angle: Column, threshold: float) -> Column:
    # NaN sorts above every number in Spark; the rule must treat it as failing
    return F.coalesce((angle >= F.lit(threshold)) & ~F.isnan(angle), F.lit(False))


def posture_class(cva_l: Column, cva_r: Column, fha_l: Column, fha_r: Column,
                  landmarks: Column, t_cva: float = CVA_THRESHOLD,
                  t_fha: float = FHA_THRESHOLD) -> Column:
    """True/False for a found pose (NULL or NaN angles fail), NULL when no pose."""
    ok = ((_at_least(cva_l, t_cva) | _at_least(cva_r, t_cva))
          & (_at_least(fha_l, t_fha) | _at_least(fha_r, t_fha)))
    return F.when(landmarks.isNotNull(), ok)


# ---- staged form for DataFrames ---------------------------------------------
# Writing all four angles as one nested expression repeats the C7 midpoint and
# the arm vectors dozens of times and overflows the 64 KB generated-method
# limit.  The staged form materialises each level once; Catalyst keeps the
# stages apart (their columns are reused, so collapsing would duplicate work)
# and they still run inside one whole-stage-codegen span.
#
# The auxiliary arm of every angle has one non-zero component
# ``d = (c + s) - c`` along the shifted axis, so ``dot = arm[axis] * d`` and
# ``|aux| = |d|``; for finite coordinates this is bit-identical to the
# three-point form (``0 * v`` terms add signed zeros, ``sqrt(d * d) = |d|``).

ANGLES = {
    # name: (ear, shifted axis, shift)
    "cva_left": ("l", "z", -AUX_OFFSET),
    "cva_right": ("r", "z", -AUX_OFFSET),
    "fha_left": ("l", "x", AUX_OFFSET),
    "fha_right": ("r", "x", AUX_OFFSET),
}


def with_neck_metrics(df, landmarks: str = "landmarks", t_cva: float = CVA_THRESHOLD,
                      t_fha: float = FHA_THRESHOLD, digits: int = ANGLE_DIGITS):
    """Add ``cva_left, cva_right, fha_left, fha_right, posture_correct`` in stages."""
    keep = list(df.columns)
    lmk = F.col(landmarks)
    c7 = {a: (lmk["ls"][a] + lmk["rs"][a]) / 2 for a in "xyz"}
    arms = {f"_b{side}{a}": lmk[ear][a] - c7[a] for side, ear in (("l", "le"), ("r", "re"))
            for a in "xyz"}
    arms["_dz"] = (c7["z"] + F.lit(-AUX_OFFSET)) - c7["z"]
    arms["_dx"] = (c7["x"] + F.lit(AUX_OFFSET)) - c7["x"]
    df = df.withColumns(arms)
    b = {k: F.col(k) for k in arms}
    df = df.withColumns({f"_n{side}": F.sqrt(b[f"_b{side}x"] * b[f"_b{side}x"]
                                             + b[f"_b{side}y"] * b[f"_b{side}y"]
                                             + b[f"_b{side}z"] * b[f"_b{side}z"])
                         for side in "lr"})
    angles = {}
    for name, (side, axis, _) in ANGLES.items():
        d = F.col(f"_d{axis}")
        cos = F.try_divide(F.col(f"_b{side}{axis}") * d, F.col(f"_n{side}") * F.abs(d))
        angles[name] = round_half_even(F.degrees(F.acos(cos)), digits)
    df = df.select(*keep, *[v.alias(k) for k, v in angles.items()])
    return df.withColumn("posture_correct", posture_class(
        F.col("cva_left"), F.col("cva_right"), F.col("fha_left"), F.col("fha_right"), lmk,
        t_cva, t_fha))
