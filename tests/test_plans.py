"""Physical-plan properties the operators are designed to have."""

import __spark_entry__ as E
from conftest import SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_prunes_scan_and_aggregates_partially(spark):
    plan = _plan(E.queries()["profile_mean"](spark, SMALL))
    read = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "l_shipdate" not in read and "l_returnflag" not in read and "l_quantity" in read
    assert "partial_avg" in plan and plan.count("Exchange hashpartitioning") == 1


def test_attribution_text_uses_one_exchange(spark):
    plan = _plan(E.queries()["attribution_text"](spark, SMALL))
    assert plan.count("Exchange") == 1
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_no_cartesian_or_nested_loop_anywhere(spark):
    from panelstats.plans.modelling import MODEL_QUERIES
    for key in set(E.oracle_sql()) - set(MODEL_QUERIES):
        plan = _plan(E.queries()[key](spark, SMALL))
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, key


def test_first_row_and_mode_are_partial_aggregates_not_windows(spark):
    # min_by/max_by over a struct run as sort-based aggregates, with the partial step on
    # the map side: a hot key is reduced per task, never gathered whole by one
    for key, fn in (("first_row_per_key", "partial_min_by"), ("mode_first_seen", "partial_max_by")):
        plan = _plan(E.queries()[key](spark, SMALL))
        assert "Window" not in plan and fn in plan, key
