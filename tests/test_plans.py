"""Physical plans: what must never appear, and what has to reach the scan."""

import re

import pytest

import __spark_entry__ as contract

# Source, sink and streaming queries run jobs of their own before the final plan exists.
PLANNED = sorted(n for n in contract.queries() if not re.match(r"[skr]\d|u6_", n) or n == "s12_generate_problems")
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]


def plan_of(spark, sf_dir, name):
    return contract.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_row_products_and_no_row_python(spark, sf_dir, name):
    plan = plan_of(spark, sf_dir, name)
    assert not [w for w in FORBIDDEN if w in plan]


def test_first_per_group_drops_rows_before_the_shuffle(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "t2_first_per_depth")
    assert re.search(r"WindowGroupLimit.*Final", plan) and re.search(r"WindowGroupLimit.*Partial", plan)


def test_scoring_has_one_aggregation_shuffle_and_reads_three_columns(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "a1_accuracy_at_depth")
    assert plan.count("ENSURE_REQUIREMENTS") == 1
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan
    # each response is parsed once
    assert len(re.findall(re.escape("[Aa]nswer"), plan)) == 1


def test_comparisons_scan_once(spark, sf_dir):
    for name in ("j5_variant_drop", "j7_gap_to_best", "j8_method_delta", "a19_depth_ceiling", "a8_multi_seed_accuracy"):
        assert plan_of(spark, sf_dir, name).count("FileScan") == 1


def test_filters_reach_the_scan(spark, sf_dir):
    from tallymark.operators.scoring import select_members
    from tallymark.plans.registry import table

    df = select_members(table(spark, sf_dir, "events"), "event_type", ["click", "view"]).select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type, [click,view])]" in plan


def test_fold_is_evaluated_once(spark, sf_dir):
    for name in ("w6_chunk_fold", "x37_context_update", "a6_chunk_diagnostics"):
        plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("emergency_fallback") == 1


def test_a_bucketed_log_is_read_in_place(spark, sf_dir):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the log of a test is small
    try:
        plan = plan_of(spark, sf_dir, "j1_resume_bucketed")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    planned, log = plan[plan.index("SortMergeJoin") :].split("FileScan")[0::2]
    assert "SelectedBucketsCount: 16 out of 16" in log
    # one shuffle of the planned rows, one of the counts, none of the log
    assert plan.count("ENSURE_REQUIREMENTS") == 2 and "Exchange hashpartitioning(model" in planned
