"""Callers' own functions. They run on Arrow batches in Python workers; prefer built-ins."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def register_scalar(spark: SparkSession, name: str, function: Callable[..., pd.Series], kind: str) -> None:
    """Make a function of pandas Series callable from SQL and ``call_function``."""
    spark.udf.register(name, F.pandas_udf(function, kind))


def register_table(spark: SparkSession, name: str, handler: type, columns: str) -> None:
    """Make a handler class with ``eval`` callable as a table function in SQL."""
    spark.udtf.register(name, F.udtf(handler, returnType=columns))


def batch_partials(df: DataFrame, partial: Callable[[pd.DataFrame], pd.DataFrame], columns: str) -> DataFrame:
    """Partial results of a caller's aggregate, one small frame per Arrow batch.

    The caller merges them with built-in aggregates. No group is ever held whole, unlike
    with a grouped-aggregate Pandas function.
    """

    texts = [f.name for f in StructType.fromDDL(columns) if isinstance(f.dataType, StringType)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            result = partial(batch)
            # pandas holds a text column of nulls only as numbers
            yield result.assign(**{t: result[t].astype(object).where(result[t].notna(), None) for t in texts})

    return df.mapInPandas(run, columns)


def value_band(value: pd.Series) -> pd.Series:
    bands = pd.Series(np.select([value >= 100, value >= 10], ["high", "middle"], "low"), index=value.index)
    return bands.where(value.notna(), None)


def log_sums(batch: pd.DataFrame) -> pd.DataFrame:
    """Count and sum of logarithms of positive values per event type."""
    positive = batch[batch["value"] > 0]
    logs = np.log(positive["value"]).groupby(positive["event_type"], dropna=False)
    return pd.DataFrame({"n": logs.size(), "log_sum": logs.sum()}).reset_index()


class JsonEntries:
    """The entries of a JSON object, one row each; nothing for other text."""

    def eval(self, text: str) -> Iterator[tuple[str, str]]:
        try:
            entries = json.loads(text) if text else None
        except ValueError:
            return
        if isinstance(entries, dict):
            for name, value in entries.items():
                yield name, value if isinstance(value, str) else json.dumps(value)
