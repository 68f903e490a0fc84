from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilark.functions.numeric import ratio


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def cosine(a: Column, b: Column) -> Column:
    """Null when either vector has no length."""
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
