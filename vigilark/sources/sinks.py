"""Writing tables so that later reads prune files and later joins need no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], format: str = "parquet") -> None:
    """Overwrite only the partitions present in ``df``.

    Rows are rebalanced by the partition columns: Spark sizes the tasks at run time and
    splits large partitions, so a hot partition is written by several tasks.
    """
    (
        df.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .format(format)
        .save(path)
    )


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> None:
    """Save a table bucketed and sorted by its join keys; equal bucketing joins without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)
