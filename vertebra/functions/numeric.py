"""Rounding that matches numpy's ``round``: scale, round half to even, unscale.

Spark's ``bround`` rounds the decimal text of a double, which differs from
numpy (and DuckDB ``round_even``) on values such as 142.515; ``rint`` on the
scaled double reproduces numpy bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(col: Column | str, digits: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def exact_mean_fixed(col: Column, digits: int) -> Column:
    """Mean of values that carry ``digits`` decimals, summed as integers.

    The sum is exact and order-independent, so partial aggregation on any
    partitioning gives the same double (one correctly rounded division).
    """
    scale = float(10 ** digits)
    units = F.rint(col * F.lit(scale)).cast("long")
    return F.sum(units) / (F.count(units) * F.lit(scale))


# parts of an exact sum: multiples of 2^-7, 2^-30 and 2^-53, each at most 2^23 in number
_PARTS = ((7, 7), (30, 23), (53, 23))
EXACT_BOUND = 65536.0


def exact_mean(name: str) -> Column:
    """Mean of the double column ``name`` whose sum does not depend on the order of addition
    (an aggregate).

    Each value is split into three whole numbers, of units 2^-7, 2^-30 and 2^-53, which are
    summed as 64-bit integers (2^40 rows fit; one more than fit fails, it never wraps).  So any
    partitioning, retry or partial aggregation gives the same double.  The split is exact for
    values that are multiples of 2^-53, as all of magnitude 1/2 or more are; smaller ones are
    rounded to that unit.  Values of ``EXACT_BOUND`` or more in magnitude, infinities and NaN
    are added as plain doubles.  NULLs are left out; no value gives NULL.
    """
    fits = f"abs({name}) < {EXACT_BOUND}D"  # NaN is above every number
    sums, rest = [], name
    for unit, step in _PARTS:
        rest = f"({rest} * {float(1 << step)}D)"
        sums.append(f"coalesce(sum(CASE WHEN {fits} THEN CAST(rint({rest}) AS BIGINT) END), 0) * {2.0 ** -unit!r}D")
        rest = f"({rest} - rint({rest}))"
    far = f"sum(CASE WHEN NOT ({fits}) THEN {name} END)"
    total = f"({' + '.join(sums)})"  # left to right, each sum rounded once
    return F.expr(f"CASE WHEN count({name}) > 0 THEN CASE WHEN {far} IS NULL THEN {total} ELSE {total} + {far} END / count({name}) END")
