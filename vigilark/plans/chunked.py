"""Ordered work per key without putting a whole key in one task.

A window partitioned by the key alone sends every row of a hot key to one task. Here a
key's rows are cut into chunks along their order, at bounds that split all rows evenly: a
hot key, a hot day, or both at once still fall into many chunks. Each chunk is summed up
in one row (combined map-side), a window over these few rows gives what every chunk
inherits from the earlier ones, and the inherited values enter the chunk as one extra
leading row. So the rows are shuffled once, by key and chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vigilark.plans.keyed import join_null_safe
from vigilark.plans.rounds import sized

CHUNK = "_chunk"
IS_ROW = "_is_row"


def earlier_chunks(keys: Sequence[str], descending: bool = False) -> WindowSpec:
    """All chunks of the key before the current one."""
    order = F.col(CHUNK).desc() if descending else F.col(CHUNK).asc()
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def within_chunk(keys: Sequence[str], order: Sequence[Column]) -> WindowSpec:
    """Running window inside one chunk, from the inherited row to the current row."""
    return (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(F.col(IS_ROW), *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def spread(df: DataFrame, chunks: int | None) -> int:
    """How many chunks to cut: as many as the session has shuffle partitions, if not given."""
    return chunks or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def chunk_bounds(df: DataFrame, order: str, n: int, points: int = 256) -> DataFrame:
    """One row with ``bounds``: at most ``n`` - 1 values that part the rows about evenly.

    The splits are dealt to ``n`` groups, whose quantile sketches are merged by as many tasks, not all by
    one. Each group gives ``points`` quantiles that stand for its rows; these few rows, whose number
    follows the chunks and not the data, are cumulated into the bounds.
    """
    at = [(i + 0.5) / points for i in range(points)]
    groups = (
        df.where(F.col(order).isNotNull())
        .select(F.col(order).alias("v"), F.pmod(F.spark_partition_id(), F.lit(n)).alias("g"))
        .groupBy("g")
        .agg(F.percentile_approx("v", at, 10 * points).alias("q"), F.count("*").alias("c"))
    )
    weights = groups.select(F.explode("q").alias("v"), (F.col("c") / points).alias("w")).groupBy("v").agg(F.sum("w").alias("w"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.floor(n * F.sum("w").over(upto) / F.sum("w").over(whole) + 1e-9)
    firsts = weights.select("v", place.alias("k")).where(F.col("k").between(1, n - 1)).groupBy("k").agg(F.min("v").alias("v"))
    return firsts.agg(F.array_sort(F.collect_set("v")).alias("bounds"))


def in_chunks(df: DataFrame, order: str, chunks: int | None = None) -> DataFrame:
    """Number the rows' chunks along a number or time; nulls fall into the first.

    Bounds are approximate quantiles over all rows, so a chunk holds about rows / chunks of
    them whatever the keys. The few bounds are written first: all uses see the same ones, and
    the rows are read once for them and once for the work itself.
    """
    n = spread(df, chunks)
    bounds = sized(chunk_bounds(df, order, n)).scalar()
    # How many bounds lie below the value, by halving; each step stays in generated code.
    found = df.withColumns({"_bounds": bounds, CHUNK: F.lit(0)})
    step = 1 << (n.bit_length() - 1)
    while step:
        above = F.get("_bounds", F.col(CHUNK) + step - 1) < F.col(order)
        found = found.withColumn(CHUNK, F.col(CHUNK) + F.when(above, step).otherwise(0))
        step //= 2
    return found.drop("_bounds")


def with_inherited(
    rows: DataFrame, keys: Sequence[str], totals: dict[str, Column], inherited: dict[str, Column]
) -> DataFrame:
    """Rows from ``in_chunks`` plus one leading row per key and chunk with the ``inherited`` values.

    ``totals`` are aggregates of one chunk; ``inherited`` are expressions over
    ``earlier_chunks(keys)`` that read them. On ordinary rows the inherited columns are null.
    The caller computes over ``within_chunk`` and then keeps ``only_rows``.
    """
    summary = rows.groupBy(*keys, CHUNK).agg(*[c.alias(n) for n, c in totals.items()])
    leading = summary.select(*keys, CHUNK, *[c.alias(n) for n, c in inherited.items()])
    return rows.withColumn(IS_ROW, F.lit(1)).unionByName(
        leading.withColumn(IS_ROW, F.lit(0)), allowMissingColumns=True
    )


def only_rows(df: DataFrame, *drop: str) -> DataFrame:
    return df.where(F.col(IS_ROW) == 1).drop(IS_ROW, CHUNK, *drop)


def value_ranks(df: DataFrame, groups: Sequence[str], value: str, chunks: int | None = None) -> DataFrame:
    """One row per group and distinct value: how many rows equal it and lie below it.

    Also, on every row, the count, least, greatest, mean and sample deviation of the group.
    """
    keys = list(groups)
    rows = in_chunks(df.where(F.col(value).isNotNull()).select(*keys, value), value, chunks)
    group = Window.partitionBy(*keys)
    parts = (
        rows.groupBy(*keys, CHUNK)
        .agg(
            F.count("*").alias("_n"),
            F.min(value).alias("_low"),
            F.max(value).alias("_high"),
            F.avg(value).alias("_avg"),
            F.var_pop(value).alias("_var"),
        )
        .withColumn("n_total", F.sum("_n").over(group))
        .withColumn("mean", F.sum(F.col("_n") * F.col("_avg")).over(group) / F.col("n_total"))
    )
    squares = F.sum(F.col("_n") * (F.col("_var") + F.pow(F.col("_avg") - F.col("mean"), 2))).over(group)
    leading = parts.select(
        *keys,
        CHUNK,
        F.lit(0).alias(IS_ROW),
        F.coalesce(F.sum("_n").over(earlier_chunks(keys)), F.lit(0)).alias("_before"),
        "n_total",
        F.min("_low").over(group).alias("lowest"),
        F.max("_high").over(group).alias("highest"),
        "mean",
        F.sqrt(F.try_divide(squares, F.col("n_total") - 1)).alias("deviation"),
    )
    counts = rows.groupBy(*keys, CHUNK, value).agg(F.count("*").alias("n_equal")).withColumn(IS_ROW, F.lit(1))
    w = within_chunk(keys, [F.col(value)])
    of_group = ["n_total", "lowest", "highest", "mean", "deviation"]
    ranked = counts.unionByName(leading, allowMissingColumns=True).select(
        *keys,
        value,
        "n_equal",
        (F.first("_before").over(w) + F.coalesce(F.sum("n_equal").over(w), F.lit(0)) - F.col("n_equal")).alias("n_below"),
        *[F.first(c).over(w).alias(c) for c in of_group],
        IS_ROW,
    )
    return ranked.where(F.col(IS_ROW) == 1).drop(IS_ROW)


def ranks_around(
    df: DataFrame, groups: Sequence[str], value: str, fractions: Sequence[float], chunks: int | None = None
) -> DataFrame:
    """Ranks as in ``value_ranks``, only for the chunks in which the given fractions of a group fall.

    All rows are counted per chunk, which shuffles one row per task, group and chunk. Then
    only rows of the chunks that matter are shuffled. Adds ``fraction`` and the places
    ``low`` and ``high`` (from 0) on either side of it.
    """
    keys = list(groups)
    rows = in_chunks(df.where(F.col(value).isNotNull()).select(*keys, value), value, chunks)
    totals = rows.groupBy(*keys, CHUNK).agg(F.count("*").alias("_rows"))
    located = totals.select(
        *keys,
        CHUNK,
        "_rows",
        F.coalesce(F.sum("_rows").over(earlier_chunks(keys)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("n_total"),
    ).withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    place = F.col("fraction") * (F.col("n_total") - 1)
    located = located.withColumns({"low": F.floor(place), "high": F.ceil(place), "part": place - F.floor(place)})
    inside = lambda p: (F.col("_before") <= F.col(p)) & (F.col(p) < F.col("_before") + F.col("_rows"))
    wanted = sized(located.where(inside("low") | inside("high")).drop("_rows", "n_total"))
    place_of = ["fraction", "_before", "low", "high", "part"]
    counts = (
        join_null_safe(rows, wanted, [*keys, CHUNK])
        .groupBy(*keys, CHUNK, *place_of, value)
        .agg(F.count("*").alias("n_equal"))
    )
    w = Window.partitionBy(*keys, CHUNK, "fraction").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("n_below", F.col("_before") + F.coalesce(F.sum("n_equal").over(w), F.lit(0)))
