from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from vigilark.operators import periods as ops


def test_period_change_uses_the_calendar_not_the_row_before(spark):
    days = [("a", dt.datetime(2020, 1, 5), 10.0), ("a", dt.datetime(2020, 1, 9), 10.0), ("a", dt.datetime(2020, 3, 1), 5.0),
            ("a", dt.datetime(2020, 4, 1), 10.0), ("a", dt.datetime(2021, 1, 1), 8.0), (None, dt.datetime(2020, 2, 1), 1.0)]
    df = spark.createDataFrame(days, "g string, t timestamp_ntz, v double")
    got = ops.period_change(df, ["g"], "t", "v")
    assert rows(got.where("g = 'a'"), F.date_format("month", "yyyy-MM"), "total", "previous", "relative_change", "year_ago") == [
        ("2020-01", 20.0, None, None, None),
        ("2020-03", 5.0, None, None, None),
        ("2020-04", 10.0, 5.0, 1.0, None),
        ("2021-01", 8.0, None, None, 20.0),
    ]


def test_pivot_and_back(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("b", 2, 1.0)], "g string, p int, v double")
    wide = ops.pivot_periods(df, ["g"], F.col("p"), [1, 2], "v")
    assert rows(wide, "g", "p_1", "p_2") == [("a", 5.0, None), ("b", None, 1.0)]
    long = ops.unpivot_metrics(wide, ["g"], ["p_1", "p_2"])
    assert rows(long.where("value is not null")) == [("a", "p_1", 5.0), ("b", "p_2", 1.0)]


def test_snapshot_diff_with_null_keys_and_values(spark):
    old = spark.createDataFrame([(1, "x"), (2, None), (3, "z"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (4, "w"), (None, "m")], "k int, v string")
    assert rows(ops.snapshot_diff(old, new, ["k"], ["v"])) == [
        (None, "changed", "n", "m"), (2, "changed", None, "y"), (3, "removed", "z", None), (4, "added", None, "w")
    ]


def test_feeds(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "y", 5)], "k int, v string, extra int")
    both = ops.combine_feeds({"a": a, "b": b})
    assert rows(both, "feed", "k", "extra") == [("a", 1, None), ("a", 1, None), ("a", 2, None), ("b", 2, 5)]
    assert rows(ops.in_both(a, b.drop("extra"))) == [(2, "y")]
    assert rows(ops.only_in_first(a, b.drop("extra"))) == [(1, "x")]


def test_upsert_is_idempotent_and_keeps_the_newer(spark):
    now = spark.createDataFrame([(1, 5, "old"), (2, 5, "old"), (3, 9, "old"), (None, 1, "old")], "k int, version int, v string")
    new = spark.createDataFrame([(2, 6, "new"), (3, 8, "new"), (4, 1, "new"), (1, 5, "new"), (None, 2, "new")], "k int, version int, v string")
    once = ops.upsert_latest(now, new, ["k"], "version")
    want = [(None, "new"), (1, "new"), (2, "new"), (3, "old"), (4, "new")]
    assert rows(once, "k", "v") == want
    assert rows(ops.upsert_latest(once, new, ["k"], "version"), "k", "v") == want


def test_periods_that_are_not_listed_are_other(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 9, 3.0), ("a", None, 4.0)], "g string, p int, v double")
    assert rows(ops.pivot_periods(df, ["g"], F.col("p"), [1], "v"), "g", "p_1", "p_other") == [("a", 2.0, 7.0)]
