"""The plan shapes the README promises, checked on executed plans."""
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402

from support import SF01  # noqa: E402


def _executed(spark, name):
    df = E.queries()[name](spark, SF01)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_and_top_k_limit_before_the_shuffle(spark):
    for name in ("dedup_lineitem_latest", "top_customers_by_nation"):
        plan = E.queries()[name](spark, SF01)._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan, name


def test_sessionize_shares_one_exchange(spark):
    assert "ReusedExchange" in _executed(spark, "sessionize")


def test_cutoff_filters_reach_the_scan(spark):
    # (examples_with_features scans inside its eager per-day checkpoint job)
    for name in ("features_at_cutoff", "label_examples"):
        plan = E.queries()[name](spark, SF01)._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(ts), LessThan(ts," in plan, name


@pytest.mark.parametrize("name", ["rule_violations", "pair_rules_brand", "negative_sample",
                                  "as_of_last_view", "rfm", "prediction_checks",
                                  "target_encode_segment", "audience_diff"])
def test_no_nested_loop_or_cartesian_joins(spark, name):
    plan = _executed(spark, name)
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
