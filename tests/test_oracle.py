"""Every registered query against its SQL on whole tables, and what its plan must not hold."""

from __future__ import annotations

import pytest

import __spark_entry__
from compare import connect, difference
from vigilark import registry

DATA = "/root/testdata/sf0.01"
__spark_entry__.queries()
QUERIES, SQL = registry.QUERIES, registry.SQL


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name in SQL:
        assert difference(df, con, SQL[name]) is None
    else:
        assert df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if not name.startswith(("user_scalar", "user_aggregate", "user_table")):
        assert "Python" not in plan and "Pandas" not in plan


def test_sql_has_no_orphans():
    assert set(SQL) <= set(QUERIES)


def test_entry_returns_the_rollup(spark):
    assert __spark_entry__.entry(spark).count() > 1
