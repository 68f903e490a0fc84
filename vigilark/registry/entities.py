"""Queries on suppliers, customers and their facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.functions.numeric import exact
from vigilark.operators import entities as ops
from vigilark.operators import links, profiles, rules
from vigilark.plans.keyed import join_null_safe
from vigilark.registry import query
from vigilark.sources.scan import checked_scan
from vigilark.sources.tables import schema_of, table


def _one() -> Column:
    return F.lit(1).cast("bigint")


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return ops.attach_hierarchy(
        table(spark, d, "supplier"),
        [
            (table(spark, d, "nation"), "s_nationkey", "n_nationkey"),
            (table(spark, d, "region"), "n_regionkey", "r_regionkey"),
        ],
    )


def _spend(spark: SparkSession, d: str) -> DataFrame:
    return ops.entity_totals(
        table(spark, d, "lineitem"), "l_suppkey", {"spend": exact(F.col("l_extendedprice")), "n_lines": _one()}
    )


def _supplier_spend(spark: SparkSession, d: str) -> DataFrame:
    return _spend(spark, d).join(_suppliers(spark, d), F.col("l_suppkey") == F.col("s_suppkey"))


def _as_double(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast("double"))


def _in_period(facts: DataFrame, start: str, end: str) -> DataFrame:
    ship = F.col("l_shipdate")
    return facts.where((ship >= F.lit(start).cast("timestamp_ntz")) & (ship < F.lit(end).cast("timestamp_ntz")))


@query(
    """
    SELECT c AS column_name, CAST(n AS BIGINT) AS n_rows, CAST(n - p AS BIGINT) AS n_null, lo AS lowest, hi AS highest
    FROM (
        SELECT 'o_orderkey' AS c, count(*) AS n, count(o_orderkey) AS p,
               CAST(min(o_orderkey) AS VARCHAR) AS lo, CAST(max(o_orderkey) AS VARCHAR) AS hi FROM orders
        UNION ALL
        SELECT 'o_custkey', count(*), count(o_custkey),
               CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR) FROM orders
        UNION ALL
        SELECT 'o_orderstatus', count(*), count(o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders
        UNION ALL
        SELECT 'o_orderpriority', count(*), count(o_orderpriority), min(o_orderpriority), max(o_orderpriority)
        FROM orders
        UNION ALL
        SELECT 'o_totalprice', count(*), count(o_totalprice), printf('%.2f', min(o_totalprice)), printf('%.2f', max(o_totalprice)) FROM orders
        UNION ALL
        SELECT 'o_orderdate', count(*), count(o_orderdate), CAST(min(o_orderdate) AS VARCHAR), CAST(max(o_orderdate) AS VARCHAR) FROM orders
    )
    """
)
def checked_scan_profile(spark: SparkSession, d: str) -> DataFrame:
    """A scan held to its schema, and what its columns hold."""
    orders = checked_scan(spark, f"{d}/orders.parquet", schema_of("orders"))
    return profiles.column_profile(orders.withColumn("o_totalprice", exact(F.col("o_totalprice"))), orders.columns)


@query(
    """
    SELECT l_orderkey, l_partkey, l_suppkey, round(l_extendedprice * l_discount, 4) AS discount_given
    FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
      AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
    """
)
def filter_project(spark: SparkSession, d: str) -> DataFrame:
    """P02."""
    lines = _in_period(table(spark, d, "lineitem"), "1996-01-01", "1997-01-01")
    return lines.where(F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24)).select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.round(F.col("l_extendedprice") * F.col("l_discount"), 4).alias("discount_given"),
    )


@query(
    """
    SELECT s_suppkey, s_name, n_name, r_name
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    """
)
def entity_dimension_join(spark: SparkSession, d: str) -> DataFrame:
    """P03."""
    return _suppliers(spark, d).select("s_suppkey", "s_name", "n_name", "r_name")


@query(
    """
    SELECT c_custkey, c_name FROM customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
                  AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-07-01')
    """
)
def covered_entities(spark: SparkSession, d: str) -> DataFrame:
    """Customers with an order in the period."""
    return ops.covered_entities(
        table(spark, d, "customer"), _orders_1997(spark, d), "c_custkey", "o_custkey"
    ).select("c_custkey", "c_name")


@query(
    """
    SELECT c_custkey, c_name FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
                      AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-07-01')
    """
)
def uncovered_entities(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order in the period."""
    return ops.uncovered_entities(
        table(spark, d, "customer"), _orders_1997(spark, d), "c_custkey", "o_custkey"
    ).select("c_custkey", "c_name")


def _orders_1997(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, d, "orders").where(
        (day >= F.lit("1997-01-01").cast("timestamp_ntz")) & (day < F.lit("1997-07-01").cast("timestamp_ntz"))
    )


@query(
    """
    SELECT o_orderkey, o_orderpriority,
           round((o_totalprice - min(o_totalprice) OVER g) / nullif(max(o_totalprice) OVER g - min(o_totalprice) OVER g, 0), 6)
               AS o_totalprice_min_max,
           round((o_totalprice - avg(o_totalprice) OVER g) / nullif(stddev_samp(o_totalprice) OVER g, 0), 6)
               AS o_totalprice_z_score,
           round(percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice), 6) AS o_totalprice_pct_rank
    FROM orders
    WINDOW g AS (PARTITION BY o_orderpriority)
    """
)
def normalise_metric(spark: SparkSession, d: str) -> DataFrame:
    """Order value within its priority."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    scored = ops.normalise_metric(orders, ["o_orderpriority"], "o_totalprice")
    names = ["o_totalprice_min_max", "o_totalprice_z_score", "o_totalprice_pct_rank"]
    return scored.select("o_orderkey", "o_orderpriority", *[F.round(n, 6).alias(n) for n in names])


_SCORES_SQL = """
    WITH spend AS (
        SELECT l_suppkey, sum(l_extendedprice) AS spend,
               count(*) FILTER (WHERE l_returnflag = 'R') / CAST(count(*) AS DOUBLE) AS returned
        FROM lineitem GROUP BY l_suppkey
    ), scored AS (
        SELECT s_suppkey, r_name,
               (s_acctbal - min(s_acctbal) OVER g) / nullif(max(s_acctbal) OVER g - min(s_acctbal) OVER g, 0) AS a,
               (returned - min(returned) OVER g) / nullif(max(returned) OVER g - min(returned) OVER g, 0) AS b
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN spend ON l_suppkey = s_suppkey
        WINDOW g AS (PARTITION BY r_name)
    ), final AS (
        SELECT s_suppkey, r_name,
               (coalesce(a, 0) * 0.4 + coalesce(b, 0) * 0.6)
               / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.4 END + CASE WHEN b IS NULL THEN 0 ELSE 0.6 END, 0) AS score
        FROM scored
    )
"""


def _supplier_scores(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned")
    )
    peers = ["r_name"]
    metrics = _suppliers(spark, d).join(returned, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(
        "s_suppkey", "r_name", "s_acctbal", "returned"
    )
    scored = ops.normalise_metrics(metrics, "s_suppkey", peers, ["s_acctbal", "returned"])
    both = metrics.join(scored, "s_suppkey")
    return ops.composite_score(both, {"s_acctbal_min_max": 0.4, "returned_min_max": 0.6})


@query(_SCORES_SQL + "SELECT s_suppkey, r_name, round(score, 6) AS score FROM final")
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    """Balance and returned share of suppliers, against the region."""
    return _supplier_scores(spark, d).select("s_suppkey", "r_name", F.round("score", 6).alias("score"))


@query(
    """
    SELECT r_name, n_name, CAST(grouping(r_name, n_name) AS BIGINT) AS level_id,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS spend, CAST(count(*) AS BIGINT) AS n_lines
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, n_name)
    """
)
def hierarchy_rollup(spark: SparkSession, d: str) -> DataFrame:
    """P07."""
    rolled = ops.hierarchy_rollup(_supplier_spend(spark, d), ["r_name", "n_name"], ["spend", "n_lines"])
    return _as_double(rolled, "spend")


def _measures() -> dict[str, Column]:
    revenue = exact(F.col("l_extendedprice")) * (1 - exact(F.col("l_discount")))
    return {"quantity": F.col("l_quantity"), "revenue": revenue, "n_lines": _one()}


@query(
    """
    SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level_id,
           sum(l_quantity) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue,
           CAST(count(*) AS BIGINT) AS n_lines
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
    """
)
def cross_cube(spark: SparkSession, d: str) -> DataFrame:
    """P08."""
    cube = ops.cross_cube(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], _measures())
    return _as_double(cube, "revenue")


@query(
    """
    SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level_id,
           sum(l_quantity) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue,
           CAST(count(*) AS BIGINT) AS n_lines
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))
    """
)
def chosen_sets(spark: SparkSession, d: str) -> DataFrame:
    """P08, explicit sets."""
    sets = ops.chosen_sets(
        table(spark, d, "lineitem"),
        [["l_returnflag"], ["l_linestatus"]],
        ["l_returnflag", "l_linestatus"],
        _measures(),
    )
    return _as_double(sets, "revenue")


@query(
    _SCORES_SQL
    + """
    SELECT c_mktsegment, round(sum(l_extendedprice), 2) AS amount,
           round(sum(l_extendedprice * score) / nullif(sum(CASE WHEN score IS NULL THEN NULL ELSE l_extendedprice END), 0), 6)
               AS exposure
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    LEFT JOIN final ON l_suppkey = s_suppkey
    GROUP BY c_mktsegment
    """
)
def weighted_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Spend-weighted supplier score per customer segment."""
    scores = _supplier_scores(spark, d).select("s_suppkey", "score")
    # The fact is reduced by order and supplier before it is joined, and meets orders that already know their segment.
    spend = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_extendedprice").alias("spend"))
    segments = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")
    facts = (
        spend.join(segments, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("c_mktsegment", "l_suppkey")
        .agg(F.sum("spend").alias("spend"))
        .join(scores, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    )
    return ops.weighted_exposure(facts, ["c_mktsegment"], "spend", "score").select(
        "c_mktsegment", F.round("amount", 2).alias("amount"), F.round("exposure", 6).alias("exposure")
    )


@query(
    """
    WITH s AS (
        SELECT r_name, s_suppkey, sum(l_extendedprice) AS spend
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY r_name, s_suppkey
    )
    SELECT r_name, CAST(count(*) AS BIGINT) AS n_entities,
           round(sum(spend * spend) / (sum(spend) * sum(spend)), 8) AS herfindahl
    FROM s GROUP BY r_name
    """
)
def concentration(spark: SparkSession, d: str) -> DataFrame:
    """P10."""
    spend = _as_double(_supplier_spend(spark, d), "spend")
    return ops.concentration(spend, ["r_name"], "s_suppkey", "spend").withColumn(
        "herfindahl", F.round("herfindahl", 8)
    )


@query(
    """
    WITH s AS (
        SELECT n_name, s_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS spend
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY n_name, s_suppkey
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY spend DESC, s_suppkey) AS position FROM s
    )
    SELECT n_name, s_suppkey, spend, CAST(position AS BIGINT) AS position FROM r WHERE position <= 2
    """
)
def top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The two largest suppliers per nation."""
    spend = _as_double(_supplier_spend(spark, d), "spend").select("n_name", "s_suppkey", "spend")
    return ops.top_k_per_group(spend, ["n_name"], [F.col("spend").desc(), F.col("s_suppkey")], 2)


@query(
    """
    WITH q AS (
        SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, [0.05, 0.5, 0.95]) AS q
        FROM lineitem GROUP BY l_returnflag, l_linestatus
    )
    SELECT l_returnflag, l_linestatus, CAST(0.05 AS DOUBLE) AS fraction, round(q[1], 4) AS quantile FROM q
    UNION ALL SELECT l_returnflag, l_linestatus, CAST(0.5 AS DOUBLE), round(q[2], 4) FROM q
    UNION ALL SELECT l_returnflag, l_linestatus, CAST(0.95 AS DOUBLE), round(q[3], 4) FROM q
    """
)
def quantile_profile(spark: SparkSession, d: str) -> DataFrame:
    """P16."""
    return profiles.quantile_profile(
        table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.05, 0.5, 0.95]
    ).withColumn("quantile", F.round("quantile", 4))


@query(
    """
    SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS n_distinct FROM events GROUP BY event_type
    """
)
def distinct_users(spark: SparkSession, d: str) -> DataFrame:
    """P17, exact mode."""
    return profiles.distinct_counts(table(spark, d, "events"), ["event_type"], "user_id")


@query(
    """
    SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS n_distinct, TRUE AS estimate_within_3_percent
    FROM events GROUP BY event_type
    """
)
def distinct_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Users per type, merged from daily sketches, beside the exact count."""
    events = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    daily = profiles.distinct_sketch(events, ["event_type", "day"], "user_id")
    merged = profiles.merge_sketches(daily, ["event_type"]).toDF("event_type", "estimate")
    near = F.abs(F.col("estimate") - F.col("n_distinct")) <= 0.03 * F.col("n_distinct")
    exact = profiles.distinct_counts(events, ["event_type"], "user_id")
    return join_null_safe(exact, merged, ["event_type"]).select("event_type", "n_distinct", near.alias("estimate_within_3_percent"))


@query(
    """
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(count(*) AS BIGINT) AS n_reports,
           CAST(count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS BIGINT) AS n_versions
    FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    """
)
def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    """P19 re-aimed at facts: lines reported more than once under one key."""
    lines, keys = table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    repeated = ops.repeated_keys(lines, keys, [c for c in lines.columns if c not in keys])
    return repeated.withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))


@query(
    """
    WITH s AS (
        SELECT floor(o_totalprice / 10000) AS step, returned IS NOT NULL AS actual
        FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS returned FROM lineitem WHERE l_returnflag = 'R')
        ON o_orderkey = returned
    ), c AS (
        SELECT step, count(*) FILTER (WHERE actual) AS yes, count(*) FILTER (WHERE NOT actual) AS no FROM s GROUP BY step
    ), m AS (
        SELECT CAST(step * 10000 AS DOUBLE) AS threshold,
               CAST(sum(yes) OVER w AS BIGINT) AS tp, CAST(sum(no) OVER w AS BIGINT) AS fp,
               CAST(sum(yes) OVER () - sum(yes) OVER w AS BIGINT) AS fn,
               CAST(sum(no) OVER () - sum(no) OVER w AS BIGINT) AS tn
        FROM c WINDOW w AS (ORDER BY step DESC)
    )
    SELECT threshold, tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative,
           round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS precision,
           round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall,
           round(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 6) AS f1
    FROM m
    """
)
def rule_metrics(spark: SparkSession, d: str) -> DataFrame:
    """P27 re-aimed at facts: does a high order value foretell a return?"""
    returned = (
        table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("returned")).distinct()
    )
    scored = (
        table(spark, d, "orders")
        .join(returned, F.col("o_orderkey") == F.col("returned"), "left")
        .select("o_totalprice", F.col("returned").isNotNull().alias("actual"))
    )
    metrics = rules.rule_metrics(scored, "o_totalprice", "actual", 10000)
    return metrics.withColumns({n: F.round(n, 6) for n in ("precision", "recall", "f1")})


@query(
    """
    WITH g AS (
        SELECT o_custkey, least(2 * o_custkey, min(2 * o_orderkey + 1)) AS group_id FROM orders GROUP BY o_custkey
    )
    SELECT 'customer' AS kind, o_custkey AS key, CAST(group_id AS BIGINT) AS group_id FROM g
    UNION ALL
    SELECT 'order', o_orderkey, CAST(group_id AS BIGINT) FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders) JOIN g USING (o_custkey)
    """
)
def linked_groups(spark: SparkSession, d: str) -> DataFrame:
    """P21 re-aimed at entities: customers and orders linked by all orders."""
    pairs = table(spark, d, "orders").select((2 * F.col("o_custkey")).alias("a"), (2 * F.col("o_orderkey") + 1).alias("b"))
    found = links.linked_groups(pairs, "a", "b")
    return found.select(
        F.when(F.col("entity") % 2 == 0, "customer").otherwise("order").alias("kind"),
        F.floor(F.col("entity") / 2).alias("key"),
        "group_id",
    )
