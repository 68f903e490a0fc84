"""Groups of vectors: their centre, and how far members lie from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.functions.vectors import cosine
from vigilark.operators.entities import top_k_per_group
from vigilark.operators.profiles import quantile_profile
from vigilark.plans.keyed import join_null_safe
from vigilark.plans.rounds import sized


def _of_length(vector: str, length: int) -> Column:
    """The vector; one of another length is an error rather than cut."""
    fits = F.col(vector).isNull() | (F.size(vector) == length)
    wrong = F.raise_error(F.format_string(f"a vector of {vector} has %d values, not {length}", F.size(vector)))
    return F.when(fits, F.col(vector)).otherwise(wrong)


def group_centroids(df: DataFrame, groups: Sequence[str], vector: str, length: int) -> DataFrame:
    """Mean vector per group, as one aggregate per position: no row is multiplied. Null vectors are left out of the means."""
    checked = df.where(_of_length(vector, length).isNotNull() | F.col(vector).isNull())  # once per row
    at = lambda i: F.avg(F.get(vector, F.lit(i)).cast("double"))
    return checked.groupBy(*groups).agg(
        F.count("*").alias("n_members"), F.array(*[at(i) for i in range(length)]).alias("centroid")
    )


def similarity_to_centroid(
    df: DataFrame, key: str, groups: Sequence[str], vector: str, length: int
) -> DataFrame:
    """Cosine of each vector with the centroid of its own group."""
    centroids = sized(group_centroids(df, groups, vector, length).select(*groups, "centroid"))
    return join_null_safe(df, centroids, groups).select(
        key, *groups, cosine(F.col(vector), F.col("centroid")).alias("similarity")
    )


def central_members(
    df: DataFrame, key: str, groups: Sequence[str], vector: str, length: int, k: int
) -> DataFrame:
    """The ``k`` vectors per group most similar to its centroid."""
    scored = similarity_to_centroid(df, key, groups, vector, length)
    return top_k_per_group(scored, groups, [F.round("similarity", 9).desc(), F.col(key)], k)


def centroid_outliers(
    df: DataFrame, key: str, groups: Sequence[str], vector: str, length: int, fraction: float
) -> DataFrame:
    """Vectors whose distance to their centroid exceeds the given quantile of their group."""
    scored = sized(
        similarity_to_centroid(df, key, groups, vector, length).select(key, *groups, F.round(1 - F.col("similarity"), 9).alias("distance"))
    )
    bounds = quantile_profile(scored, groups, "distance", [fraction])
    bounds = sized(bounds.select(*groups, F.round("quantile", 9).alias("bound")))
    return join_null_safe(scored, bounds, groups).where("distance > bound")
