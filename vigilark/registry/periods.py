"""Queries that compare periods, snapshots and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.operators import periods as ops
from vigilark.registry import query
from vigilark.sources.tables import table

YEARS = list(range(1995, 2002))


@query(
    """
    WITH m AS (
        SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month,
               year(o_orderdate) * 12 + month(o_orderdate) AS i, sum(o_totalprice) AS total
        FROM orders GROUP BY ALL
    )
    SELECT a.o_orderpriority, CAST(a.month AS TIMESTAMP) AS month, round(a.total, 2) AS total,
           round(p.total, 2) AS previous, round(a.total - p.total, 2) AS change,
           round((a.total - p.total) / nullif(p.total, 0), 6) AS relative_change, round(y.total, 2) AS year_ago
    FROM m a
    LEFT JOIN m p ON a.o_orderpriority = p.o_orderpriority AND a.i = p.i + 1
    LEFT JOIN m y ON a.o_orderpriority = y.o_orderpriority AND a.i = y.i + 12
    """
)
def period_change(spark: SparkSession, d: str) -> DataFrame:
    """P12."""
    changed = ops.period_change(table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice")
    return changed.withColumns(
        {
            **{n: F.round(n, 2) for n in ("total", "previous", "change", "year_ago")},
            "relative_change": F.round("relative_change", 6),
        }
    )


def _by_year(spark: SparkSession, d: str) -> DataFrame:
    pivoted = ops.pivot_periods(
        table(spark, d, "orders"), ["o_orderpriority"], F.year("o_orderdate"), YEARS, "o_totalprice"
    )
    return pivoted.select("o_orderpriority", *[F.round(f"p_{y}", 2).alias(f"p_{y}") for y in [*YEARS, "other"]])


@query(
    "SELECT o_orderpriority, "
    + ", ".join(
        f"round(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = {y}), 2) AS p_{y}" for y in YEARS
    )
    + f", round(sum(o_totalprice) FILTER (WHERE coalesce(year(o_orderdate) NOT IN ({', '.join(map(str, YEARS))}), TRUE)), 2) AS p_other"
    + " FROM orders GROUP BY o_orderpriority"
)
def pivot_periods(spark: SparkSession, d: str) -> DataFrame:
    """P13."""
    return _by_year(spark, d)


@query(
    """
    SELECT o_orderpriority, 'p_' || CAST(year(o_orderdate) AS VARCHAR) AS metric, round(sum(o_totalprice), 2) AS value
    FROM orders GROUP BY ALL
    """
)
def unpivot_metrics(spark: SparkSession, d: str) -> DataFrame:
    """P13, back to long form."""
    return ops.unpivot_metrics(_by_year(spark, d), ["o_orderpriority"], [f"p_{y}" for y in YEARS])


_PAIRS_SQL = """
    WITH old AS (
        SELECT l_partkey, l_suppkey, sum(l_quantity) AS quantity FROM lineitem
        WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY ALL
    ), new AS (
        SELECT l_partkey, l_suppkey, sum(l_quantity) AS quantity FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY ALL
    )
"""


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, d, "lineitem")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    total = lambda df: df.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"))
    return total(lines.where(F.col("l_shipdate") < cut)), total(lines.where(F.col("l_shipdate") >= cut))


@query(
    _PAIRS_SQL
    + """
    SELECT l_partkey, l_suppkey,
           CASE WHEN o.quantity IS NULL THEN 'added' WHEN n.quantity IS NULL THEN 'removed' ELSE 'changed' END AS status,
           o.quantity AS old_quantity, n.quantity AS new_quantity
    FROM old o FULL JOIN new n USING (l_partkey, l_suppkey)
    WHERE o.quantity IS DISTINCT FROM n.quantity
    """
)
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Quantity per part and supplier before and after a date."""
    old, new = _pairs(spark, d)
    return ops.snapshot_diff(old, new, ["l_partkey", "l_suppkey"], ["quantity"])


@query(
    _PAIRS_SQL
    + """
    SELECT 'old' AS feed, CAST(count(*) AS BIGINT) AS n_rows, sum(quantity) AS quantity,
           CAST(NULL AS DOUBLE) AS balance FROM old
    UNION ALL SELECT 'new', count(*), sum(quantity), NULL FROM new
    UNION ALL SELECT 'supplier', count(*), NULL, round(sum(s_acctbal), 2) FROM supplier
    """
)
def combine_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Three feeds of unlike columns, then totals per feed."""
    old, new = _pairs(spark, d)
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("balance"))
    return (
        ops.combine_feeds({"old": old, "new": new, "supplier": suppliers})
        .groupBy("feed")
        .agg(
            F.count("*").alias("n_rows"),
            F.sum("quantity").alias("quantity"),
            F.round(F.sum("balance"), 2).alias("balance"),
        )
    )


@query(_PAIRS_SQL + "SELECT l_partkey, l_suppkey FROM old INTERSECT SELECT l_partkey, l_suppkey FROM new")
def in_both(spark: SparkSession, d: str) -> DataFrame:
    """Pairs seen before and after."""
    keys = [df.select("l_partkey", "l_suppkey") for df in _pairs(spark, d)]
    return ops.in_both(*keys)


@query(_PAIRS_SQL + "SELECT l_partkey, l_suppkey FROM old EXCEPT SELECT l_partkey, l_suppkey FROM new")
def only_in_first(spark: SparkSession, d: str) -> DataFrame:
    """Pairs seen before only."""
    keys = [df.select("l_partkey", "l_suppkey") for df in _pairs(spark, d)]
    return ops.only_in_first(*keys)


@query(
    """
    WITH old AS (
        SELECT l_partkey, l_suppkey, sum(l_quantity) AS quantity, max(l_shipdate) AS as_of FROM lineitem
        WHERE l_returnflag <> 'N' GROUP BY ALL
    ), new AS (
        SELECT l_partkey, l_suppkey, sum(l_quantity) AS quantity, max(l_shipdate) AS as_of FROM lineitem
        WHERE l_returnflag = 'N' GROUP BY ALL
    )
    SELECT l_partkey, l_suppkey,
           CASE WHEN o.as_of IS NULL OR n.as_of >= o.as_of THEN n.quantity ELSE o.quantity END AS quantity,
           CASE WHEN o.as_of IS NULL OR n.as_of >= o.as_of THEN n.as_of ELSE o.as_of END AS as_of
    FROM old o FULL JOIN new n USING (l_partkey, l_suppkey)
    """
)
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """P43, table form: unreturned quantities laid over returned ones, the later date winning."""
    lines = table(spark, d, "lineitem")
    total = lambda df: df.groupBy("l_partkey", "l_suppkey").agg(
        F.sum("l_quantity").alias("quantity"), F.max("l_shipdate").alias("as_of")
    )
    old, new = total(lines.where("l_returnflag <> 'N'")), total(lines.where("l_returnflag = 'N'"))
    return ops.upsert_latest(old, new, ["l_partkey", "l_suppkey"], "as_of")
