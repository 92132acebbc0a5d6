"""What the plans must look like: pruned scans, partial aggregation, no nested loops."""

import re

import pytest
from conftest import DATA

from tidemark.queries import all_queries

QUERIES = all_queries()


def plan(spark, name):
    return QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def read_columns(text, column):
    """The columns read by the scans that read ``column``."""
    scans = [set(re.findall(r"(\w+)#", m)) for m in re.findall(r"FileScan parquet \[([^\]]*)\]", text)]
    return [s for s in scans if column in s]


@pytest.mark.parametrize("name", [n for n in QUERIES if n[0] == "p" and n[1].isdigit()])
def test_problems_have_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_surplus_reads_five_columns_and_combines_map_side(spark):
    text = plan(spark, "p1_found")
    scans = read_columns(text, "kafka_offset")
    assert scans and all(s <= {"event_id", "simulated_arrival_at", "batch_id", "kafka_partition", "kafka_offset", "kafka_timestamp"} for s in scans)
    assert "partial_min_by" in text


def test_rolling_reads_five_of_twenty_nine_columns(spark):
    scans = read_columns(plan(spark, "p5_found"), "transaction_id")
    assert scans and all(s <= {"transaction_id", "customer_id", "merchant_id", "event_timestamp", "amount"} for s in scans)


def test_filters_reach_the_scan(spark):
    text = plan(spark, "orphans_anti")
    assert "PushedFilters: [IsNotNull(o_orderkey)]" in text


def test_top_k_is_limited_before_the_shuffle(spark):
    text = plan(spark, "top_workloads_per_group")
    assert text.count("WindowGroupLimit") >= 2


def test_dedup_and_metrics_need_no_python(spark):
    for name in ("p1_found", "p4_found", "p5_found", "daily_payment_metrics", "behavior_features_merchant", "event_exceptions"):
        assert "Python" not in plan(spark, name) and "InPandas" not in plan(spark, name)
