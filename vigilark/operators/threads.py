"""Ordered messages of a thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark.plans.chunked import CHUNK, IS_ROW, earlier_chunks, in_chunks, only_rows, with_inherited, within_chunk


def with_previous(df: DataFrame, key: str, order: str, value: str, chunks: int | None = None) -> DataFrame:
    """Add ``previous``: the value one step earlier in the thread; equal steps go by the value."""
    merged = with_inherited(
        in_chunks(df, order, chunks),
        [key],
        {"_last": F.max(F.struct(order, value))[value]},
        {value: F.last("_last").over(earlier_chunks([key]))},
    )
    w = Window.partitionBy(key, CHUNK).orderBy(IS_ROW, order, value)
    return only_rows(merged.withColumn("previous", F.lag(value).over(w)))


def thread_summary(df: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """Messages per thread, steps where the role did not change, roles and characters."""
    stepped = with_previous(df.select(key, order, role, F.length(text).alias("_length")), key, order, role)
    return stepped.groupBy(key).agg(
        F.count("*").alias("n_turns"),
        F.count_if(F.col(role) == F.col("previous")).alias("n_breaks"),
        F.min_by(role, order).alias("first_role"),
        F.max_by(role, order).alias("last_role"),
        F.sum("_length").alias("n_chars"),
    )


def transcript_parts(
    df: DataFrame, key: str, order: str, tie: str, message: Column, size: int = 100_000, chunks: int | None = None
) -> DataFrame:
    """The messages of a thread in order, one below the other, as parts of ``size`` characters: (key, ``part``, ``text``).

    The parts of a thread, put together by number, are the whole transcript; all but the last are ``size`` characters long, so
    a thread of any length is in many rows, and a message may be cut. Where a message begins follows from a prefix sum over
    chunks of the order, so no task holds a thread. Messages go by ``order`` (nulls first), then ``tie``; null messages are empty.
    """
    line = F.concat(F.lit("\n"), F.coalesce(message, F.lit("")))
    rows = in_chunks(df.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(tie).alias("_tie"), line.alias("_line")), "_order", chunks)
    merged = with_inherited(
        rows.withColumn("_long", F.length("_line").cast("long")),
        ["_key"],
        {"_sum": F.sum(F.length("_line").cast("long"))},
        {"_long": F.coalesce(F.sum("_sum").over(earlier_chunks(["_key"])), F.lit(0).cast("long"))},
    )
    upto = within_chunk(["_key"], [F.col("_order"), F.col("_tie"), F.col("_line")])
    placed = only_rows(merged.withColumn("_end", F.sum("_long").over(upto)))
    # The newline before the very first message stands at -1 and falls away.
    begin = F.col("_end") - F.col("_long") - 1
    spans = placed.select("_key", "_line", begin.alias("_begin"), "_long").select(
        "_key", "_line", "_begin", "_long",
        F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(F.col("_begin") / size)), F.greatest(F.lit(0).cast("long"), F.floor((F.col("_begin") + F.col("_long") - 1) / size)))).alias("part"),
    )
    start = F.greatest(F.lit(0).cast("long"), F.col("part") * size, F.col("_begin"))
    stop = F.least(F.col("part") * size + size, F.col("_begin") + F.col("_long"))
    piece = F.substring("_line", (start - F.col("_begin") + 1).cast("int"), (stop - start).cast("int"))
    pieces = spans.select("_key", "part", F.struct(start.alias("at"), piece.alias("text")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "")
    return pieces.groupBy("_key", "part").agg(joined.alias("text")).withColumnRenamed("_key", key)
