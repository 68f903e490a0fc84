from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-case runs of letters, in order; an empty word where text starts or ends otherwise."""
    return F.split(F.lower(text), r"[^\p{L}]+")
