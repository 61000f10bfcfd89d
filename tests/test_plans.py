"""Plan shape checks: semi-joins, pruning, no pair explosions, no row-at-a-time Python."""

import pytest

import __spark_entry__ as E
from tenure.operators import universe as U
from tenure.sources.fixtures import Tables


def plan_of(df):
    df.count()  # materialise so AQE shows its final plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_users_is_a_left_semi_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = plan_of(U.keep_users(t.tx, t.user_logs.select("msno").distinct()))
    assert "LeftSemi" in p


def test_scans_read_only_needed_columns(spark, sf_dir):
    df = E.queries()["tx_bounds"](spark, sf_dir)
    s = df._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in s and "l_comment" not in s
    assert "ReadSchema: struct<l_orderkey:bigint>" in s


@pytest.mark.parametrize("name", ["feature_table", "interval_log_means", "tx_profile",
                                  "calendar_fill", "rate_histogram", "roc_auc", "one_hot_long"])
def test_no_cartesian_or_nested_loop(spark, sf_dir, name):
    p = plan_of(E.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["feature_table", "tx_profile", "z_boundary", "interval_log_means",
                                  "seasonal_decompose_7", "roc_points"])
def test_no_python_udf_in_core_queries(spark, sf_dir, name):
    p = plan_of(E.queries()[name](spark, sf_dir))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "FlatMapGroupsInPandas" not in p


def test_plan_changes_take_one_exchange_of_the_rows(spark, sf_dir):
    p = plan_of(E.queries()["tx_profile"](spark, sf_dir))
    # the row-level window partitions by (msno, calendar bucket), never by msno alone
    assert "_b#" in p and "rangepartitioning" not in p.lower()
    assert p.split("Initial Plan")[0].count("l_quantity") and _scans(p, "lineitem") <= 2


def _scans(plan, table):
    final = plan.split("== Initial Plan ==")[0]
    return sum("FileScan parquet" in line and f"{table}.parquet" in line for line in final.splitlines())


def test_feature_table_reduces_transactions_to_common_users_first(spark, sf_dir):
    df = E.queries()["feature_table"](spark, sf_dir)
    p = plan_of(df)
    assert "LeftSemi" in p and any("tenure-stage/usage_block" in f for f in df.inputFiles())
    assert _scans(p, "events") == 0 and _scans(p, "lineitem") <= 2      # the events are in the written block


def test_usage_block_reads_events_twice(spark, sf_dir):
    from tenure.operators import logs as L
    from tenure.operators import transactions as X
    from tenure.sources.fixtures import LOG_LAST_DAY
    t = Tables(spark, sf_dir)
    p = plan_of(L.log_block(t.user_logs, X.tx_bounds(t.tx_ev), LOG_LAST_DAY))
    assert _scans(p, "events") <= 2


def test_decomposition_needs_no_join_of_its_own(spark, sf_dir):
    p = plan_of(E.queries()["seasonal_decompose_7"](spark, sf_dir)).split("== Initial Plan ==")[0]
    assert p.count("Join") == 1         # the calendar's left join


def test_samples_take_no_ordered_merge_of_rows(spark, sf_dir):
    for name in ("sample_exact", "sample_slice", "downsample_union", "stratified_sample"):
        assert "TakeOrderedAndProject" not in plan_of(E.queries()[name](spark, sf_dir))
