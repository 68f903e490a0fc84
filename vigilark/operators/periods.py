"""Comparing periods, snapshots and feeds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark.functions.numeric import ratio
from vigilark.functions.temporal import month_index, month_start


def period_change(facts: DataFrame, groups: Sequence[str], time: str, amount: str) -> DataFrame:
    """Monthly totals with change against the month before and the same month a year before.

    The window runs over monthly totals, so its groups are as long as the history in months.
    """
    monthly = facts.groupBy(
        *groups, month_start(F.col(time)).alias("month"), month_index(F.col(time)).alias("_index")
    ).agg(F.sum(amount).alias("total"))
    by_month = Window.partitionBy(*groups).orderBy("_index")
    previous = F.max("total").over(by_month.rangeBetween(-1, -1))
    year_ago = F.max("total").over(by_month.rangeBetween(-12, -12))
    return monthly.select(
        *groups,
        "month",
        "total",
        previous.alias("previous"),
        (F.col("total") - previous).alias("change"),
        ratio(F.col("total") - previous, previous).alias("relative_change"),
        year_ago.alias("year_ago"),
    )


def pivot_periods(
    facts: DataFrame, groups: Sequence[str], period: Column, periods: Sequence[int], amount: str
) -> DataFrame:
    """One column per listed period, and ``p_other`` for the rest and for no period.

    Listing them saves a pass over the data to find them; what is not listed is seen in ``p_other``.
    """
    listed = F.col("_period").isin(list(periods))
    return (
        facts.select(*groups, amount, period.alias("_period"))
        .withColumn("_period", F.when(listed, F.col("_period").cast("string")).otherwise("other"))
        .groupBy(*groups)
        .pivot("_period", [*map(str, periods), "other"])
        .agg(F.sum(amount))
        .withColumnsRenamed({str(p): f"p_{p}" for p in [*periods, "other"]})
    )


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(metrics), "metric", "value")


def _side_by_side(old: DataFrame, new: DataFrame, keys: Sequence[str], before: Column, after: Column) -> DataFrame:
    """``keys`` with structs ``_old`` and ``_new`` of the two rows; null keys are equal."""
    left = old.select(*keys, before.alias("_old"))
    right = new.select(*[F.col(k).alias(f"_right_{k}") for k in keys], after.alias("_new"))
    same = reduce(and_, [left[k].eqNullSafe(right[f"_right_{k}"]) for k in keys])
    key = lambda k: F.when(F.col("_old").isNull(), F.col(f"_right_{k}")).otherwise(F.col(k)).alias(k)
    return left.join(right, same, "full_outer").select(*[key(k) for k in keys], "_old", "_new")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Added, removed and changed rows between two versions keyed by ``keys``."""
    status = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    )
    return _side_by_side(old, new, keys, F.struct(*values), F.struct(*values)).select(
        *keys,
        status.alias("status"),
        *[F.col(f"_old.{v}").alias(f"old_{v}") for v in values],
        *[F.col(f"_new.{v}").alias(f"new_{v}") for v in values],
    ).where("status is not null")


def combine_feeds(feeds: dict[str, DataFrame], name: str = "feed") -> DataFrame:
    """Union by column name; columns a feed lacks are null there."""
    tagged = [df.withColumn(name, F.lit(n)) for n, df in feeds.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows in both lists. Both are made distinct first, so hot rows do not travel."""
    return left.distinct().intersect(right.distinct())


def only_in_first(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of the first list that the second lacks."""
    return left.distinct().subtract(right.distinct())


def upsert_latest(
    current: DataFrame, updates: DataFrame, keys: Sequence[str], version: str
) -> DataFrame:
    """``current`` with ``updates`` applied by key; the higher version wins, on a tie the update.

    Both inputs hold a key at most once.
    """
    values = [c for c in current.columns if c not in keys]
    both = _side_by_side(current, updates, keys, F.struct(*values), F.struct(*values))
    keeps = F.col("_new").isNull() | (F.col(f"_old.{version}") > F.col(f"_new.{version}"))
    winner = F.when(keeps, F.col("_old")).otherwise(F.col("_new"))
    return both.select(*keys, winner.alias("_row")).select(*keys, *[f"_row.{v}" for v in values])
