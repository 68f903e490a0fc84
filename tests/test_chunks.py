from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from vigilark.plans.chunked import CHUNK, in_chunks
from vigilark.plans.keyed import join_null_safe


def largest_share(df, *columns):
    total = df.count()
    return df.groupBy(*columns).count().agg(F.max("count")).first()[0] / total


@pytest.mark.parametrize("chunks", [2, 16, 50])
def test_a_hot_user_on_a_hot_day_is_split(spark, chunks):
    """Half of the rows are one user's, and nearly all of those lie within one day."""
    users = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 97))
    hour = F.when(F.col("id") % 2 == 0, F.col("id") % 1440 / 60).otherwise(F.col("id") % 20_000)
    start = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    df = spark.range(20_000).select(users.alias("u"), (start + F.make_dt_interval(mins=(hour * 60).cast("int"))).alias("t"))
    cut = in_chunks(df, "t", chunks)
    assert largest_share(cut, "u", CHUNK) <= 1.5 / chunks
    bounds = [tuple(r) for r in cut.groupBy(CHUNK).agg(F.min("t"), F.max("t")).orderBy(CHUNK).collect()]
    assert all(a[2] < b[1] for a, b in zip(bounds, bounds[1:]))


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,)], "v double")
    assert rows(in_chunks(df, "v", 2).where("v is null"), CHUNK) == [(0,)]
    assert in_chunks(df.where("v > 5"), "v", 4).count() == 0


def test_null_keys_join(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([(None, 9), ("a", 8)], "k string, y int")
    assert rows(join_null_safe(left, right, ["k"], "left"), "k", "x", "y") == [(None, 1, 9), ("a", 2, 8), ("b", 3, None)]
    with pytest.raises(ValueError):
        join_null_safe(left, right, [])


def test_chunks_follow_the_partitions_beyond_a_thousand(spark):
    df = spark.range(0, 200_000, 1, 16).select(F.col("id").cast("double").alias("v"))
    cut = in_chunks(df, "v", 2000)
    assert cut.select(CHUNK).distinct().count() > 1900 and largest_share(cut, CHUNK) <= 3 / 2000


def test_bounds_of_sorted_and_repeated_values(spark):
    """Splits of a sorted input cover parts of the range only; half of the rows have one value."""
    df = spark.range(0, 20_000, 1, 16).select(F.greatest(F.col("id") - 10_000, F.lit(0)).alias("v"))
    cut = in_chunks(df, "v", 10)
    assert largest_share(cut.where("v > 0"), CHUNK) <= 0.3
    bounds = [tuple(r) for r in cut.groupBy(CHUNK).agg(F.min("v"), F.max("v")).orderBy(CHUNK).collect()]
    assert all(a[2] < b[1] for a, b in zip(bounds, bounds[1:]))
