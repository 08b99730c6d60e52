"""Plan-shape regressions: properties that matter at scale, checked on final AQE plans."""

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
import plan_report as P  # noqa: E402

SF = "/root/testdata/sf0.001"


def _names(spark, q):
    return [c for c, _ in P.final_nodes(E.queries()[q](spark, SF))]


def test_no_nested_loop_or_cartesian_joins(spark):
    for q in E.queries():
        names = _names(spark, q)
        assert "BroadcastNestedLoopJoinExec" not in names and "CartesianProductExec" not in names, q


def test_calendar_grid_reads_the_frames_once(spark):
    names = _names(spark, "q_calendar_grid")
    assert names.count("ReusedExchangeExec") >= 1
    # one scan of events and one of embeddings (its broadcast is shared)
    assert names.count("FileSourceScanExec") == 2


def test_block_scans_read_the_blocks_only(spark):
    # the frames were read when the blocks were written; both passes read those
    for q in ("q_status_carry", "q_capture_gaps"):
        names = _names(spark, q)
        assert "FileSourceScanExec" not in names, q
        assert names.count("ShuffleExchangeExec") + names.count("ReusedExchangeExec") <= 5, q


def test_mart_has_one_shuffle(spark):
    names = _names(spark, "q_daily_stat")
    assert names.count("ShuffleExchangeExec") == 1 and "SortMergeJoinExec" not in names


def test_star_is_one_pass(spark):
    names = _names(spark, "q_star_join")
    assert names.count("FileSourceScanExec") == 2  # events, and the poses
    assert names.count("ShuffleExchangeExec") <= 1
