"""The shape of the plans: what must reach the scan and what must not occur."""

from __future__ import annotations

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()


def plan(spark, name):
    return QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(spark, "filter_project")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(l_shipdate" in text and "LessThan(l_quantity" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in text


@pytest.mark.parametrize("name", ["top_k_per_group", "central_members"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", ["hierarchy_rollup", "concentration", "cross_cube", "distinct_users", "weighted_exposure"])
def test_aggregates_are_combined_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "partial_sum" in text or "partial_count" in text


@pytest.mark.parametrize("name", ["user_sessions", "as_of_latest", "drift_alarms", "thread_summary"])
def test_ordered_work_is_cut_into_chunks(spark, name):
    assert "_chunk" in plan(spark, name)
