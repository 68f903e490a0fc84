"""Column profiles, quantiles and distinct counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.plans.chunked import ranks_around
from vigilark.plans.keyed import join_null_safe
from vigilark.plans.rounds import sized


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, nulls, least and greatest value per column, from one pass without a wide shuffle."""
    parts = []
    for c in columns:
        parts += [
            F.count(c).alias(f"{c}__n"),
            F.min(c).cast("string").alias(f"{c}__low"),
            F.max(c).cast("string").alias(f"{c}__high"),
        ]
    wide = df.agg(F.count("*").alias("_rows"), *parts)
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"{c}__n").alias("n_present"),
                F.col(f"{c}__low").alias("lowest"),
                F.col(f"{c}__high").alias("highest"),
            )
            for c in columns
        ]
    )
    return wide.select("_rows", F.inline(entries)).select(
        "column_name",
        F.col("_rows").alias("n_rows"),
        (F.col("_rows") - F.col("n_present")).alias("n_null"),
        "lowest",
        "highest",
    )


def quantile_profile(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    fractions: Sequence[float],
    approximate: bool = False,
    chunks: int | None = None,
) -> DataFrame:
    """Quantiles per group, one row per group and fraction, interpolated between neighbours.

    Exact quantiles come from exact counts of the distinct values, so a large group is
    spread over tasks. The approximate mode is one sketch per group, without interpolation.
    """
    if approximate:
        sketch = df.groupBy(*groups).agg(F.percentile_approx(value, list(fractions), 10000).alias("_q"))
        pairs = F.arrays_zip(F.array(*[F.lit(float(f)) for f in fractions]).alias("fraction"), F.col("_q").alias("quantile"))
        return sketch.select(*groups, F.inline(pairs).alias("fraction", "quantile"))
    ranks = ranks_around(df, groups, value, fractions, chunks)
    covers = lambda place: (F.col("n_below") <= F.col(place)) & (F.col(place) < F.col("n_below") + F.col("n_equal"))
    ends = ranks.where(covers("low") | covers("high")).groupBy(*groups, "fraction").agg(
        F.max(F.when(covers("low"), F.col(value))).alias("_a"),
        F.max(F.when(covers("high"), F.col(value))).alias("_b"),
        F.max("part").alias("_part"),
    )
    return ends.select(
        *groups, "fraction", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("quantile")
    )


def distinct_counts(df: DataFrame, groups: Sequence[str], member: str) -> DataFrame:
    """Exact distinct members per group. Members are made distinct first, combined map-side."""
    return df.where(F.col(member).isNotNull()).select(*groups, member).distinct().groupBy(*groups).agg(
        F.count("*").alias("n_distinct")
    )


def distinct_sketch(df: DataFrame, groups: Sequence[str], member: str, log_size: int = 14) -> DataFrame:
    """A mergeable sketch of the distinct members per group; fixed size whatever the data."""
    return df.groupBy(*groups).agg(F.hll_sketch_agg(member, log_size).alias("sketch"))


def merge_sketches(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Approximate distinct counts for coarser groups, from finer sketches alone."""
    return sketches.groupBy(*groups).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct_estimate")
    )


def volume_by_source(df: DataFrame, source: str, kind: str, size: str) -> DataFrame:
    """Items and their total size per source, per kind, and in all."""
    finest = df.groupBy(source, kind).agg(F.count("*").alias("n_items"), F.sum(size).alias("total_size"))
    return finest.groupingSets([[source], [kind], []], source, kind).agg(
        F.sum("n_items").alias("n_items"), F.sum("total_size").alias("total_size")
    )


#: Values a KLL sketch keeps, and the share of all rows by which a rank may then be off in 99 of 100 cases (the sketch's stated error).
KLL_SIZE, KLL_ERROR = 400, 0.0077


def quantile_sketches(df: DataFrame, groups: Sequence[str], value: str, parts: int = 16, size: int = KLL_SIZE) -> DataFrame:
    """A mergeable quantile sketch of the values per group, of bounded size: groups, ``sketch``.

    Tasks sketch what they read, and the sketches of a group meet in ``parts`` places by number of the split before they are
    merged into one, so that no task merges one per split. Nulls are left out; a group of nulls only has no row.
    """
    present = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    dealt = present.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(parts)))
    finer = dealt.groupBy(*groups, "_part").agg(F.kll_sketch_agg_double("_v", size).alias("sketch"))
    return merge_quantile_sketches(finer, groups, size)


def merge_quantile_sketches(sketches: DataFrame, groups: Sequence[str], size: int = KLL_SIZE) -> DataFrame:
    """Sketches of coarser groups, such as months from days, from finer sketches alone."""
    return sketches.groupBy(*groups).agg(F.kll_merge_agg_double("sketch", size).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, groups: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """One row per group and fraction with the estimate and the number of values: groups, ``fraction``, ``n``, ``estimate``."""
    n = F.kll_sketch_get_n_double("sketch").alias("n")
    each = [F.struct(F.lit(float(f)).alias("fraction"), n, F.kll_sketch_get_quantile_double("sketch", F.lit(float(f))).alias("estimate")) for f in fractions]
    return sketches.select(*groups, F.inline(F.array(*each)))


def rank_errors(df: DataFrame, groups: Sequence[str], value: str, estimates: DataFrame, bound: float = KLL_ERROR) -> DataFrame:
    """Whether each estimate's true rank is within ``bound`` of its fraction: groups, ``fraction``, ``n``, ``within``.

    The few estimates of a group are joined to its rows, which are counted on the way; a value that many rows share covers a range of ranks.
    """
    told = sized(estimates.groupBy(*groups).agg(F.collect_list(F.struct("fraction", "n", "estimate")).alias("_e")))
    each = join_null_safe(df.where(F.col(value).isNotNull()).select(*groups, value), told, groups).select(*groups, value, F.inline("_e"))
    counted = each.groupBy(*groups, "fraction", "n").agg(F.count_if(F.col(value) < F.col("estimate")).alias("below"), F.count_if(F.col(value) <= F.col("estimate")).alias("upto"))
    within = (F.col("below") / F.col("n") <= F.col("fraction") + bound) & (F.col("upto") / F.col("n") >= F.col("fraction") - bound)
    return counted.select(*groups, "fraction", "n", within.alias("within"))
