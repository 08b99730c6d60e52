"""The mean that does not depend on the order of addition."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from vertebra.functions.numeric import exact_mean
from vertebra.operators import mart
from vertebra.plans import catalog

SF = "/root/testdata/sf0.01"


def mean(spark, values, parts=1):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
    return df.agg(exact_mean("x").alias("m")).first()[0]


def test_close_to_the_true_mean(spark):
    rng = random.Random(1)
    for scale in (1e-3, 1.0, 640.0, 6e4):
        values = [rng.uniform(-scale, scale) for _ in range(500)]
        true = sum(map(Fraction, values)) / len(values)
        got = Fraction(mean(spark, values))
        assert abs(got - true) <= abs(true) * Fraction(2, 1 << 52) + Fraction(1, 1 << 53)


def test_cancellation_keeps_what_plain_addition_loses(spark):
    values = [40000.0, 2.0 ** -40, -40000.0] * 50
    assert mean(spark, values, 3) == 50 * 2.0 ** -40 / 150


def test_the_same_bits_in_any_order_and_partitioning(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.uniform(-1, 1), rng.uniform(-5e4, 5e4), rng.uniform(-1e-9, 1e-9)]) for _ in range(2000)]
    found = set()
    for parts in (1, 2, 7, 40):
        rng.shuffle(values)
        found.add(mean(spark, values, parts))
    assert len(found) == 1


def test_edges(spark):
    assert mean(spark, []) is None and mean(spark, [None, None]) is None
    assert mean(spark, [None, 1.0, 2.0]) == 1.5 and mean(spark, [-0.0]) == 0.0
    assert math.isnan(mean(spark, [1.0, math.nan])) and math.isnan(mean(spark, [math.inf, -math.inf]))
    assert mean(spark, [1.0, math.inf]) == math.inf and mean(spark, [1.0, 1e300]) == 5e299
    assert mean(spark, [65536.0, 65535.75]) == 65535.875


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_mart_is_bit_equal_under_any_partitioning(spark, parts):
    facts = catalog.facts(spark, SF)
    base = {r.daily_stat_id: r for r in mart.daily_stat(facts).collect()}
    other = {r.daily_stat_id: r for r in mart.daily_stat(facts.repartition(parts, F.rand(parts))).collect()}
    assert base == other
