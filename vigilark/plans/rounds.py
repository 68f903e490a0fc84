"""Tables written between steps: for iteration, and so that Spark knows a table's true size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="vigilark-")


class Rounds:
    """Writes each round's table and reads it back.

    A lost executor is made good from the last written table. Two places are used in turn, as
    a round reads only the one before it. Unlike ``checkpoint()`` this computes a round once
    and leaves Spark a size by which to choose its joins.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
        self.done = 0

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.done % 2}"
        self.done += 1
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """Write a derived table now and read it back.

    Spark takes an aggregate to be about as large as its input, and so would shuffle a large
    table to join it. Of a written table it knows the size: a small one is broadcast, a
    large one is sort-merged.
    """
    return Rounds(df.sparkSession).cut(df)
