"""How well a scored rule agrees with what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilark.functions.numeric import ratio


def rule_metrics(df: DataFrame, score: str, actual: str, step: float) -> DataFrame:
    """Confusion counts, precision, recall and F1 of ``score >= threshold``.

    Thresholds are the multiples of ``step`` that occur. Rows are first counted per
    multiple, so the running sums go over one row per threshold.
    """
    steps = (
        df.where(F.col(score).isNotNull() & F.col(actual).isNotNull())
        .groupBy(F.floor(F.col(score) / step).alias("_step"))
        .agg(F.count_if(F.col(actual)).alias("_yes"), F.count_if(~F.col(actual)).alias("_no"))
    )
    down = Window.orderBy(F.col("_step").desc())
    all_steps = Window.partitionBy()
    counted = steps.select(
        (F.col("_step") * step).cast("double").alias("threshold"),
        F.sum("_yes").over(down).alias("true_positive"),
        F.sum("_no").over(down).alias("false_positive"),
        (F.sum("_yes").over(all_steps) - F.sum("_yes").over(down)).alias("false_negative"),
        (F.sum("_no").over(all_steps) - F.sum("_no").over(down)).alias("true_negative"),
    )
    hit = F.col("true_positive")
    return counted.withColumns(
        {
            "precision": ratio(hit, hit + F.col("false_positive")),
            "recall": ratio(hit, hit + F.col("false_negative")),
            "f1": ratio(2 * hit, 2 * hit + F.col("false_positive") + F.col("false_negative")),
        }
    )
