from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def exact(value: Column, scale: int = 2) -> Column:
    """A double that holds a decimal number, as that decimal: its sums do not depend on their order."""
    return value.cast(f"decimal(18,{scale})")


def min_max(value: Column, low: Column, high: Column) -> Column:
    return ratio(value - low, high - low)


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    return ratio(value - mean, deviation)


def weighted_mean(weights: dict[str, float]) -> Column:
    """Weighted mean of columns, the weights re-scaled over those that are not null."""
    top = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    bottom = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return ratio(top, bottom)
