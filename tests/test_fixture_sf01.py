"""FIXTURES.md expected values at sf0.1."""

import pytest
from pyspark.sql import functions as F

from vertebra.operators import reports
from vertebra.plans import catalog

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def mart(spark):
    return catalog.mart(spark, SF).cache()


def test_classes_and_event_one(spark):
    a = catalog.analyzed(spark, SF)
    got = {r[0]: r[1] for r in a.groupBy("posture_correct").count().collect()}
    assert got == {True: 58834, False: 21356, None: 19810}
    r = a.filter(F.col("event_id") == 1).first()
    assert (r.cva_left, r.cva_right, r.fha_left, r.fha_right, r.posture_correct) == \
        (26.02, 141.78, 85.3, 66.42, True)


def test_reports(mart):
    d = reports.daily_report(mart, "2024-01-02").first()
    assert (d.correct_cnt, d.incorrect_cnt, d.score) == (1909, 692, 73.39)
    w = reports.weekly_score(mart, "2024-01-31").first()
    assert (w.correct_cnt, w.incorrect_cnt, w.score) == (14515, 5264, 73.39)
    assert reports.weekly_score(mart, "2024-01-31", "literal").first().score == 73.37
    lm = {r.posture_correct: r.avg_left_ear_x for r in reports.weekly_landmarks(mart, "2024-01-31").collect()}
    assert lm[True] == pytest.approx(-0.020875, abs=1e-12) and lm[False] == pytest.approx(0.0695, abs=1e-12)
    lit = [r.avg_left_ear_x for r in reports.weekly_landmarks(mart, "2024-01-31", "literal").collect()]
    assert all(v == pytest.approx(0.024016, abs=1e-6) for v in lit)
