"""Queries on the event stream, in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.functions import hooks
from vigilark.operators import events as ops
from vigilark.operators import profiles
from vigilark.plans.rounds import sized
from vigilark.registry import query
from vigilark.sources.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@query(
    """
    SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
           props IS NOT NULL AND (NOT json_valid(props) OR (json_extract_string(props, '$.k') IS NOT NULL
             AND TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL)) AS malformed
    FROM events
    """
)
def parse_props(spark: SparkSession, d: str) -> DataFrame:
    """P32."""
    return ops.parse_props(_events(spark, d), "props", {"k": "bigint"}).select("event_id", "event_type", "k", "malformed")


_HOURLY_SQL = """
    WITH hourly AS (
        SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
               event_type, CAST(count(*) AS BIGINT) AS n_events, sum(value) AS total_value
        FROM events GROUP BY ALL
    )
"""


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    return ops.windowed_counts(_events(spark, d), "ts", ["event_type"], "value", "1 hour")


@query(
    _HOURLY_SQL
    + """
    SELECT CAST(window_start AS TIMESTAMP) AS window_start, CAST(window_end AS TIMESTAMP) AS window_end, event_type,
           n_events, round(total_value, 2) AS total_value FROM hourly
    """
)
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    """P33."""
    return _hourly(spark, d).withColumn("total_value", F.round("total_value", 2))


@query(
    """
    WITH s AS (
        SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts),
                                          time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start
        FROM events
    )
    SELECT CAST(window_start AS TIMESTAMP) AS window_start, CAST(window_start + INTERVAL 1 HOUR AS TIMESTAMP) AS window_end,
           event_type, CAST(count(*) AS BIGINT) AS n_events, round(sum(value), 2) AS total_value
    FROM s GROUP BY ALL
    """
)
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    """P33, an hour long, every half hour."""
    slid = ops.windowed_counts(_events(spark, d), "ts", ["event_type"], "value", "1 hour", "30 minutes")
    return slid.withColumn("total_value", F.round("total_value", 2))


@query(
    """
    WITH f AS (
        SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOUR, TRUE) AS opens
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    ), n AS (
        SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM f
    )
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end,
           CAST(count(*) AS BIGINT) AS n_events, round(sum(value), 2) AS total_value
    FROM n GROUP BY user_id, number
    """
)
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """P34."""
    found = ops.sessions(_events(spark, d), "user_id", "ts", "value", "6 hours")
    return found.withColumn("total_value", F.round("total_value", 2))


@query(
    _HOURLY_SQL
    + """
    , measured AS (
        SELECT window_start, event_type, 'n_events' AS metric, CAST(n_events AS DOUBLE) AS measured FROM hourly
        UNION ALL SELECT window_start, event_type, 'total_value', round(total_value, 2) FROM hourly
    ), rules AS (
        SELECT event_type || '/' || metric AS rule_id, event_type, metric, round(2 * avg(measured), 4) AS bound
        FROM measured GROUP BY ALL
    )
    SELECT rule_id, CAST(window_start AS TIMESTAMP) AS window_start, event_type, metric, measured, bound
    FROM measured JOIN rules USING (event_type, metric) WHERE measured > bound
    """
)
def threshold_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Hours above twice the mean of their type; the rule table is derived from the events."""
    hourly = _hourly(spark, d).withColumn("total_value", F.round("total_value", 2))
    metrics = hourly.withColumn("n_events", F.col("n_events").cast("double")).unpivot(
        ["event_type"], ["n_events", "total_value"], "metric", "measured"
    )
    bounds = metrics.groupBy("event_type", "metric").agg(F.round(2 * F.avg("measured"), 4).alias("bound"))
    rules = bounds.withColumn("rule_id", F.concat_ws("/", "event_type", "metric"))
    return ops.threshold_alerts(hourly, rules, "event_type").select(
        "rule_id", "window_start", "event_type", "metric", "measured", "bound"
    )


@query(
    _HOURLY_SQL
    + """
    , z AS (
        SELECT *, (n_events - avg(n_events) OVER w) / nullif(stddev_samp(n_events) OVER w, 0) AS z
        FROM hourly
        WINDOW w AS (PARTITION BY event_type ORDER BY window_start ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)
    )
    SELECT event_type, CAST(window_start AS TIMESTAMP) AS window_start, n_events, round(z, 6) AS z FROM z WHERE z >= 3
    """
)
def rolling_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """P36."""
    found = ops.rolling_anomalies(_hourly(spark, d), ["event_type"], "window_start", "n_events", 24, 3.0)
    return found.select("event_type", "window_start", "n_events", F.round("z", 6).alias("z"))


def _of_type(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind).select("event_id", "user_id", "ts", "value")


@query(
    """
    SELECT e.event_id, e.user_id, e.ts, p.event_id AS purchase_id, p.ts AS purchase_ts, p.value AS purchase_value
    FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
    ON e.user_id = p.user_id AND e.ts >= p.ts
    """
)
def as_of_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last purchase at or before each error of the user."""
    events = _events(spark, d)
    columns = {"event_id": "purchase_id", "ts": "purchase_ts", "value": "purchase_value"}
    found = ops.as_of(_of_type(events, "error"), _of_type(events, "purchase"), "user_id", "ts", "event_id", columns)
    return found.drop("value")


@query(
    """
    SELECT e.event_id, e.user_id, e.ts, p.event_id AS purchase_id, p.ts AS purchase_ts
    FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
    ON e.user_id = p.user_id AND e.ts <= p.ts
    WHERE p.ts - e.ts <= INTERVAL 6 HOUR
    """
)
def followed_within(spark: SparkSession, d: str) -> DataFrame:
    """Errors followed by a purchase of the user within 6 hours, with the first such."""
    events = _events(spark, d)
    found = ops.as_of(
        _of_type(events, "error"),
        _of_type(events, "purchase"),
        "user_id",
        "ts",
        "event_id",
        {"event_id": "purchase_id", "ts": "purchase_ts"},
        forward=True,
        within="6 hours",
    )
    return found.where("purchase_id is not null").drop("value")


@query(
    """
    SELECT event_id, user_id, event_type, c_name, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey
    """
)
def enrich_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with the customer of the same number."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    return ops.enrich(_events(spark, d).select("event_id", "user_id", "event_type"), customers, "user_id")


@query(
    """
    SELECT user_id, event_type, min(ts) AS ts, min(event_id) AS event_id, arg_min(value, ts) AS value
    FROM events GROUP BY ALL
    """
)
def first_reports(spark: SparkSession, d: str) -> DataFrame:
    """P40, batch form: the first event per user and type."""
    events = _events(spark, d).select("user_id", "event_type", "ts", "event_id", "value")
    return ops.first_reports(events, ["user_id", "event_type"], ["ts", "event_id"])


@query(
    """
    WITH a AS (
        SELECT event_id, ts, event_id * 1000 + CAST(json_extract_string(props, '$.k') AS BIGINT) * 5000 AS arrival FROM events
    ), s AS (
        SELECT *, max(ts) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_until FROM a
    )
    SELECT event_id, ts, seen_until FROM s WHERE ts < seen_until - INTERVAL 6 HOUR
    """
)
def late_events(spark: SparkSession, d: str) -> DataFrame:
    """The events themselves arrive in order, so a delay is derived from their properties."""
    events = ops.parse_props(_events(spark, d), "props", {"k": "bigint"})
    arrived = events.select("event_id", "ts", (F.col("event_id") * 1000 + F.col("k") * 5000).alias("arrival"))
    return ops.late_events(arrived, "arrival", "ts", "6 hours", tie="event_id").select("event_id", "ts", "seen_until")


@query(
    """
    WITH c AS (
        SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events
    ), m AS (
        SELECT user_id, CAST(sum(cents) // count(*) AS BIGINT) AS target FROM c GROUP BY user_id
    ), r AS (
        SELECT event_id, user_id, ts, cents - target - 1000 AS step,
               sum(cents - target - 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run
        FROM c JOIN m USING (user_id)
    ), s AS (
        SELECT *, run - least(0, min(run) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS drift FROM r
    )
    SELECT event_id, user_id, ts, CAST(drift AS DOUBLE) AS drift FROM s WHERE drift > 30000 AND drift - step <= 30000
    """
)
def drift_alarms(spark: SparkSession, d: str) -> DataFrame:
    """P42, batch form: drift of a user's values, in cents, above the user's own mean."""
    cents = _events(spark, d).select(
        "event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents")
    )
    means = cents.groupBy("user_id").agg(F.expr("sum(cents) div count(*)").alias("target"))
    events = ops.enrich(cents, sized(means), "user_id")
    alarms = ops.drift_alarms(events, "user_id", "ts", "event_id", "cents", "target", 1000.0, 30000.0)
    return alarms.select("event_id", "user_id", "ts", "drift")


@query(
    """
    SELECT event_id, CASE WHEN value >= 100 THEN 'high' WHEN value >= 10 THEN 'middle' ELSE 'low' END AS band FROM events
    """
)
def user_scalar_function(spark: SparkSession, d: str) -> DataFrame:
    """A caller's scalar function, from SQL."""
    hooks.register_scalar(spark, "value_band", hooks.value_band, "string")
    return _events(spark, d).select("event_id", F.call_function("value_band", "value").alias("band"))


@query(
    """
    SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(exp(avg(ln(value))), 6) AS geometric_mean
    FROM events WHERE value > 0 GROUP BY event_type
    """
)
def user_aggregate_function(spark: SparkSession, d: str) -> DataFrame:
    """A caller's aggregate, as partial results per batch that Spark adds up."""
    parts = hooks.batch_partials(
        _events(spark, d).select("event_type", "value"), hooks.log_sums, "event_type string, n bigint, log_sum double"
    )
    return parts.groupBy("event_type").agg(
        F.sum("n").alias("n"), F.round(F.exp(F.sum("log_sum") / F.sum("n")), 6).alias("geometric_mean")
    )


@query(
    """
    SELECT event_id, json_keys(props)[1] AS name, json_extract_string(props, '$.k') AS text FROM events
    """
)
def user_table_function(spark: SparkSession, d: str) -> DataFrame:
    """A caller's table function, joined laterally."""
    hooks.register_table(spark, "json_entries", hooks.JsonEntries, "name string, text string")
    events = _events(spark, d).select("event_id", "props")
    return spark.sql(
        "SELECT e.event_id, t.name, t.text FROM {events} e, LATERAL json_entries(e.props) t", events=events
    )


@query(
    """
    SELECT e.event_id, e.user_id, e.ts, p.event_id AS purchase_id, p.ts AS purchase_ts
    FROM events e JOIN events p ON e.user_id = p.user_id AND p.ts BETWEEN e.ts AND e.ts + INTERVAL 6 HOUR
    WHERE e.event_type = 'error' AND p.event_type = 'purchase'
    """
)
def all_followers(spark: SparkSession, d: str) -> DataFrame:
    """Errors with every purchase of the user within 6 hours."""
    events = _events(spark, d)
    errors, buys = _of_type(events, "error").drop("value"), _of_type(events, "purchase")
    return ops.followers_within(errors, buys, "user_id", "ts", {"event_id": "purchase_id", "ts": "purchase_ts"}, "6 hours")


@query(
    """
    SELECT event_type, fraction, CAST(count(value) AS BIGINT) AS n, TRUE AS within
    FROM events, (VALUES (CAST(0.05 AS DOUBLE)), (0.5), (0.95)) AS f(fraction) GROUP BY event_type, fraction
    """
)
def sketched_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """P16, mergeable: quantiles per type from daily sketches, and whether their true ranks are within the stated error."""
    events = _events(spark, d).select("event_type", F.col("ts").cast("date").alias("day"), "value")
    daily = profiles.quantile_sketches(events, ["event_type", "day"], "value")
    found = profiles.sketched_quantiles(profiles.merge_quantile_sketches(daily, ["event_type"]), ["event_type"], [0.05, 0.5, 0.95])
    return profiles.rank_errors(events, ["event_type"], "value", found)
