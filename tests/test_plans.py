"""Plan guardrails: the physical plans of representative queries keep the scale
properties the design relies on."""

import pytest

from conftest import SF001

NO_PAIRS = ["a24_psi_report", "a22_iv_table", "r1_ks_table", "t04_chi_square", "t10_spearman", "t11_kendall",
            "j05_topk_cosine", "j06_knn_self_join", "c01_histogram_grouped", "l02_stratified_split", "e14_dbscan"]
TOP_K = ["w06_last_turns", "j05_topk_cosine", "j06_knn_self_join"]


def _plan(spark, name):
    import __spark_entry__ as entry
    return entry.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_cartesian_or_row_udf(spark, name):
    plan = _plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, (name, bad)


@pytest.mark.parametrize("name", TOP_K)
def test_top_k_windows_limit_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in _plan(spark, name)


def test_psi_scan_prunes_and_pushes_down(spark):
    plan = _plan(spark, "a23_psi_table")
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in plan
    assert "ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan
