"""Sinks for alerts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def alert_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each micro-batch to a folder of its own.

    A batch that is run again after a failure overwrites its folder, so it counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def start_alerts(alerts: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write alerts for all data that is available, then stop; run again to go on."""
    return (
        alerts.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(alert_writer(path))
        .start()
    )


def read_alerts(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The latest version of each alert. Only ``keys`` newest rows per task are shuffled."""
    versions = spark.read.schema(StructType([*schema.fields, StructField("batch_id", LongType())])).parquet(path)
    newest = Window.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    return versions.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "batch_id")
