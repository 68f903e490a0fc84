"""Joins on key lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the right copies of the keys are dropped.

    No broadcast is asked for. Spark broadcasts the right side when its size, estimated
    or measured at run time, is under ``autoBroadcastJoinThreshold``; otherwise it
    sort-merges and splits skewed partitions.
    """
    if not keys:
        raise ValueError("join_null_safe needs at least one key")
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = reduce(and_, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])
