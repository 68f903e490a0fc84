"""Entities, their hierarchy and the facts reported about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark.functions.numeric import min_max, ratio, weighted_mean, z_score
from vigilark.plans.chunked import value_ranks
from vigilark.plans.keyed import join_null_safe
from vigilark.plans.rounds import sized


def attach_hierarchy(entities: DataFrame, levels: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Join parent levels one after the other; each level is (parents, child key, parent key)."""
    for parents, child_key, parent_key in levels:
        entities = entities.join(parents, F.col(child_key) == F.col(parent_key))
    return entities


def entity_totals(facts: DataFrame, entity_key: str, measures: dict[str, Column]) -> DataFrame:
    """Sum measures per entity before any join, so that only one row per entity moves on."""
    return facts.groupBy(entity_key).agg(*[F.sum(c).alias(n) for n, c in measures.items()])


def covered_entities(entities: DataFrame, facts: DataFrame, entity_key: str, fact_key: str) -> DataFrame:
    """Entities with at least one fact."""
    seen = facts.select(fact_key).distinct()
    return entities.join(seen, F.col(entity_key) == F.col(fact_key), "left_semi")


def uncovered_entities(entities: DataFrame, facts: DataFrame, entity_key: str, fact_key: str) -> DataFrame:
    """Entities without a fact."""
    seen = facts.select(fact_key).distinct()
    return entities.join(seen, F.col(entity_key) == F.col(fact_key), "left_anti")


def normalise_metric(df: DataFrame, peers: Sequence[str], metric: str, chunks: int | None = None) -> DataFrame:
    """Add min-max, z-score and percent rank of ``metric`` within its peer group.

    A group without spread gives null for the first two. The percent rank is the share of
    the other peers that lie below; it is 0 for a lone peer and null for a null metric.
    """
    value = F.col(metric)
    scores = value_ranks(df, peers, metric, chunks).select(
        *peers,
        metric,
        min_max(value, F.col("lowest"), F.col("highest")).alias(f"{metric}_min_max"),
        z_score(value, F.col("mean"), F.col("deviation")).alias(f"{metric}_z_score"),
        F.coalesce(ratio(F.col("n_below"), F.col("n_total") - 1), F.lit(0.0)).alias(f"{metric}_pct_rank"),
    )
    # Written: Spark then joins two plain shuffles if it is large, and splits a value that many rows share.
    return join_null_safe(df, sized(scores), [*peers, metric], "left")


def normalise_metrics(df: DataFrame, key: str, peers: Sequence[str], metrics: Sequence[str], chunks: int | None = None) -> DataFrame:
    """The scores of ``normalise_metric`` for several metrics from one pass: key, and per metric its three scores.

    The metrics become rows, are ranked together within (peers, metric), and one join brings the scores back; the input
    is read the same number of times whatever the number of metrics. ``key`` is unique; a null metric has null scores.
    """
    long = df.select(key, *peers, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([key, *peers], list(metrics), "_metric", "_value")
    groups = [*peers, "_metric"]
    scores = value_ranks(long, groups, "_value", chunks).select(
        *groups,
        "_value",
        min_max(F.col("_value"), F.col("lowest"), F.col("highest")).alias("min_max"),
        z_score(F.col("_value"), F.col("mean"), F.col("deviation")).alias("z_score"),
        F.coalesce(ratio(F.col("n_below"), F.col("n_total") - 1), F.lit(0.0)).alias("pct_rank"),
    )
    found = join_null_safe(long, sized(scores), [*groups, "_value"], "left")
    kinds = ("min_max", "z_score", "pct_rank")
    return found.groupBy(key).agg(*[F.max(F.when(F.col("_metric") == m, F.col(k))).alias(f"{m}_{k}") for m in metrics for k in kinds])


def composite_score(df: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    return df.withColumn(name, weighted_mean(weights))


def hierarchy_rollup(totals: DataFrame, levels: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Totals for every prefix of ``levels`` and overall, with the grouping id as ``level_id``."""
    return totals.rollup(*levels).agg(
        F.grouping_id(*levels).cast("bigint").alias("level_id"),
        *[F.sum(m).alias(m) for m in measures],
    )


def cross_cube(facts: DataFrame, dimensions: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Totals over every subset of the dimensions."""
    finest = facts.groupBy(*dimensions).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    return finest.cube(*dimensions).agg(
        F.grouping_id(*dimensions).cast("bigint").alias("level_id"),
        *[F.sum(n).alias(n) for n in measures],
    )


def chosen_sets(
    facts: DataFrame, sets: Sequence[Sequence[str]], dimensions: Sequence[str], measures: dict[str, Column]
) -> DataFrame:
    """Totals over the given subsets of the dimensions."""
    finest = facts.groupBy(*dimensions).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    return finest.groupingSets([list(s) for s in sets], *dimensions).agg(
        F.grouping_id(*dimensions).cast("bigint").alias("level_id"),
        *[F.sum(n).alias(n) for n in measures],
    )


def weighted_exposure(facts: DataFrame, groups: Sequence[str], amount: str, score: str) -> DataFrame:
    """Amount-weighted mean score per group; facts without a score carry no weight."""
    weight = F.when(F.col(score).isNotNull(), F.col(amount))
    return facts.groupBy(*groups).agg(
        F.sum(amount).alias("amount"),
        ratio(F.sum(weight * F.col(score)), F.sum(weight)).alias("exposure"),
    )


def concentration(facts: DataFrame, groups: Sequence[str], entity: str, amount: str) -> DataFrame:
    """Herfindahl index per group: the sum of squared shares of its entities."""
    per_entity = facts.groupBy(*groups, entity).agg(F.sum(amount).alias("_amount"))
    return per_entity.groupBy(*groups).agg(
        F.count("*").alias("n_entities"),
        ratio(
            F.sum(F.col("_amount") * F.col("_amount")), F.sum("_amount") * F.sum("_amount")
        ).alias("herfindahl"),
    )


def top_k_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group in the given order, which must break every tie.

    Spark keeps only ``k`` rows per group and task before the shuffle, so a hot group is cheap.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    ranked = df.withColumn("position", F.row_number().over(w))
    return ranked.where(F.col("position") <= k).withColumn("position", F.col("position").cast("bigint"))


def repeated_keys(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys reported more than once, with how many different reports there are."""
    reports = df.groupBy(*keys, *values).agg(F.count("*").alias("_n"))
    return (
        reports.groupBy(*keys)
        .agg(F.sum("_n").alias("n_reports"), F.count("*").alias("n_versions"))
        .where("n_reports > 1")
    )
