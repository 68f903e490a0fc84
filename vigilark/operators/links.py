"""Groups of entities that are linked, directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.plans.rounds import Rounds, sized


def linked_groups(links: DataFrame, a: str, b: str) -> DataFrame:
    """(entity, group_id) for every entity in ``links``; the group id is its least entity.

    Alternates two steps, published as large-star and small-star by Kiveris et al. (2014):
    neighbours above an entity, then those below it, are tied to the least of them. The
    number of links does not grow, and the number of rounds is about logarithmic. A much
    linked entity only takes part in a minimum, combined map-side, and in a join with the
    written minima: both sides are then plain shuffles, which Spark splits when one is skewed.
    """
    rounds = Rounds(links.sparkSession)
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    alone = pairs.where("u = v").select("u").distinct()
    edges = rounds.cut(_downward(pairs))
    while not _are_stars(edges):
        edges = rounds.cut(_small_star(_large_star(edges)))
    members = edges.unionByName(edges.select(F.col("v").alias("u"), "v").distinct())
    lone = alone.join(members, "u", "left_anti").select("u", F.col("u").alias("v"))
    return members.unionByName(lone).select(F.col("u").alias("entity"), F.col("v").alias("group_id"))


def _downward(pairs: DataFrame) -> DataFrame:
    """Distinct links from the greater entity ``u`` to the lesser ``v``."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sized(both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m")))
    return _downward(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = sized(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _downward(moved.unionByName(least.withColumnRenamed("m", "v")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every entity has one lesser link, to an entity that has none."""
    if not edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
