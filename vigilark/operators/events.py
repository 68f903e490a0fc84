"""Event operators. Those marked "batch or stream" take either kind of DataFrame.

A streaming caller sets the watermark (see ``vigilark.streaming``) before calling. In batch
form a user's events are cut into chunks along time, see ``vigilark.plans.chunked``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from vigilark.functions.temporal import interval, micros, micros_of
from vigilark.plans.chunked import (
    CHUNK,
    IS_ROW,
    earlier_chunks,
    in_chunks,
    only_rows,
    spread,
    with_inherited,
    within_chunk,
)


def parse_props(df: DataFrame, props: str, fields: dict[str, str]) -> DataFrame:
    """Typed columns from a JSON text column (batch or stream).

    A field that is absent or not of its type is null. ``malformed`` marks text that is
    present but is not JSON, has other text after its closing bracket, or holds a value of the wrong type.
    """
    raw = {name: F.get_json_object(props, f"$.{name}") for name in fields}
    typed = {name: raw[name].try_cast(kind) for name, kind in fields.items()}
    wrong = F.lit(False)
    for name in fields:
        wrong = wrong | (raw[name].isNotNull() & typed[name].isNull())
    # Spark's parser stops after the first value. One value alone is also one as the only element and as the only member;
    # what follows it cannot be both.
    within = lambda a, b: F.try_parse_json(F.concat(F.lit(a), F.col(props), F.lit(b))).isNull()
    not_json = F.col(props).isNotNull() & (within("[", "]") | within('{"a":', "}"))
    return df.withColumns({**typed, "malformed": not_json | wrong})


def windowed_counts(
    df: DataFrame, time: str, groups: Sequence[str], value: str, length: str, slide: str | None = None
) -> DataFrame:
    """Events and total value per group and tumbling or sliding window (batch or stream)."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return (
        df.groupBy(window.alias("_window"), *groups)
        .agg(F.count("*").alias("n_events"), F.sum(value).alias("total_value"))
        .select(
            F.col("_window.start").alias("window_start"),
            F.col("_window.end").alias("window_end"),
            *groups,
            "n_events",
            "total_value",
        )
    )


def sessions(df: DataFrame, user: str, time: str, value: str, gap: str, chunks: int | None = None) -> DataFrame:
    """Sessions by inactivity gap (batch or stream); an event exactly ``gap`` later still belongs.

    In batch, sessions are first built per user and chunk of time. Only the first and the last of a chunk can reach into
    another chunk; the rest are final as they are, and at most two rows per user and chunk are merged.
    """
    found = [F.count("*").alias("n_events"), F.sum(value).alias("total_value")]
    window = F.session_window(time, gap).alias("_session")
    if df.isStreaming:
        return (
            df.groupBy(user, window)
            .agg(*found)
            .select(
                user,
                F.col("_session.start").alias("session_start"),
                F.col("_session.end").alias("session_end"),
                "n_events",
                "total_value",
            )
        )
    pieces = (
        in_chunks(df, time, chunks)
        .groupBy(user, CHUNK, window)
        .agg(*found)
        .select(user, CHUNK, F.col("_session.start").alias("_start"), F.col("_session.end").alias("_end"), "n_events", "total_value")
    )
    inside = Window.partitionBy(user, CHUNK).orderBy("_start")
    edge = F.lag("_start").over(inside).isNull() | F.lead("_start").over(inside).isNull()
    marked = pieces.withColumn("_edge", edge)
    by_start = Window.partitionBy(user).orderBy("_start")
    opens = F.coalesce(F.col("_start") > F.lag("_end").over(by_start), F.lit(True))
    numbered = marked.where("_edge").withColumn("_opens", opens.cast("int")).withColumn("_number", F.sum("_opens").over(by_start))
    merged = numbered.groupBy(user, "_number").agg(
        F.min("_start").alias("session_start"),
        F.max("_end").alias("session_end"),
        F.sum("n_events").alias("n_events"),
        F.sum("total_value").alias("total_value"),
    ).drop("_number")
    final = marked.where("not _edge").select(
        user, F.col("_start").alias("session_start"), F.col("_end").alias("session_end"), "n_events", "total_value"
    )
    return merged.unionByName(final)


def threshold_alerts(
    windows: DataFrame, rules: DataFrame, group: str, metrics: Sequence[str] | None = None
) -> DataFrame:
    """Windows whose metric exceeds a rule's bound (batch or stream).

    ``rules`` holds (rule_id, group, metric, bound), where metric is one of ``metrics``: all numeric
    columns of ``windows`` other than the group, if not given. Another metric is an error, as its alerts would be missed.
    """
    if metrics is None:
        metrics = [f.name for f in windows.schema if isinstance(f.dataType, NumericType) and f.name != group]
    unknown = rules.where(~F.coalesce(F.col("metric").isin(list(metrics)), F.lit(False))).select("metric").first()
    if unknown is not None:
        raise ValueError(f"rule on the unknown metric {unknown[0]!r}; the windows have {list(metrics)}")
    measured = windows.select(
        "window_start",
        "window_end",
        group,
        F.inline(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("measured")) for m in metrics])
        ),
    )
    return measured.join(rules, [group, "metric"]).where("measured > bound")


def rolling_anomalies(
    counts: DataFrame, groups: Sequence[str], time: str, value: str, rows: int, least_z: float
) -> DataFrame:
    """Points at least ``least_z`` sample deviations above the mean of the ``rows`` before them.

    The input is one row per group and window, so a group is as long as the history.
    """
    w = Window.partitionBy(*groups).orderBy(time).rowsBetween(-rows, -1)
    z = F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))
    return counts.withColumn("z", z).where(F.col("z") >= least_z)


def as_of(
    left: DataFrame,
    right: DataFrame,
    key: str,
    time: str,
    order: str,
    columns: dict[str, str],
    forward: bool = False,
    within: str | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Add to each left row the nearest right row of its key at or before (or at or after) it.

    ``order`` breaks ties in time: the right row with the greatest value, or in the forward
    direction the least, is the nearest. ``columns`` maps right columns to their new names.
    With ``within`` a match further away than that is dropped. All left rows are kept.
    """
    right = right.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    match = F.struct(F.col(time).alias("_t"), F.col(order).alias("_o"), *[F.col(c).alias(n) for c, n in columns.items()])
    sides = left.withColumn("_side", F.lit(1)).unionByName(
        right.select(key, time, order, match.alias("_match"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    nearest_in_chunk = (F.min if forward else F.max)("_match")
    merged = with_inherited(
        in_chunks(sides, time, chunks),
        [key],
        {"_chunk_match": nearest_in_chunk},
        {"_match": F.last("_chunk_match", ignorenulls=True).over(earlier_chunks([key], descending=forward))},
    )
    if forward:
        by_time = [F.col(time).desc(), F.col("_side").asc(), F.col(order).desc()]
    else:
        by_time = [F.col(time).asc(), F.col("_side").asc(), F.col(order).asc()]
    found = F.last("_match", ignorenulls=True).over(within_chunk([key], by_time))
    matched = only_rows(merged.withColumn("_found", found).where(F.col("_side") == 1), "_side", "_match")
    near = F.col(time).isNotNull()
    if within:
        apart = F.col("_found._t") - F.col(time) if forward else F.col(time) - F.col("_found._t")
        near = near & (apart <= interval(within))
    return matched.select(
        *left.columns, *[F.when(near, F.col(f"_found.{n}")).alias(n) for n in columns.values()]
    )


def followers_within(
    left: DataFrame, right: DataFrame, key: str, time: str, columns: dict[str, str], within: str
) -> DataFrame:
    """Every left row with every right row of its key from its time on to ``within`` later, both ends included (batch or stream).

    ``columns`` maps right columns to their new names. Time is cut into buckets as long as the span: a right row is in
    one, a left row looks into its own and the next, and the join is on key and bucket. So a hot key is as many join keys
    as there are buckets, and no row meets one that is more than two spans away. Rows without key or time have no
    followers. In a stream both sides carry a watermark on ``time``, and state is kept for the span and the delay.
    """
    span = micros_of(within)
    bucket = lambda df: F.floor(micros(df, time) / F.lit(span)).cast("bigint")
    if span <= 0:
        raise ValueError(f"the span must be longer than nothing, not {within!r}")
    ahead = left.withColumn("_bucket", F.explode(F.array(bucket(left), bucket(left) + 1)))
    names = {c: n for c, n in columns.items() if c not in (key, time)}
    later = right.select(
        F.col(key).alias("_key"), F.col(time).alias("_time"), bucket(right).alias("_place"), *[F.col(c).alias(n) for c, n in names.items()]
    )
    near = (F.col("_time") >= F.col(time)) & (F.col("_time") <= F.col(time) + interval(within))
    joined = ahead.join(later, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_place")) & near)
    repeated = {n: F.col("_key" if c == key else "_time") for c, n in columns.items() if c in (key, time)}
    return joined.withColumns(repeated).select(*left.columns, *columns.values())


def enrich(df: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """Join a table with one row per key to events (batch or stream); unknown keys stay."""
    return df.join(users, key, "left")


def first_reports(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in the given order, combined map-side; nulls of any column come last."""
    rest = [c for c in df.columns if c not in keys]
    ranked = [*order, *[c for c in rest if c not in order]]
    places = [x for c in ranked for x in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c))]
    return df.groupBy(*keys).agg(F.min(F.struct(*places)).alias("_row")).select(*keys, *[f"_row.{c}" for c in rest])


def late_events(
    df: DataFrame, arrival: str, time: str, delay: str, tie: str | None = None, chunks: int | None = None
) -> DataFrame:
    """Events more than ``delay`` behind the latest time seen before them in arrival order.

    Arrival orders all events and is cut into chunks, so the only window without a key runs
    over one row per chunk. There are a few chunks per shuffle partition, as whole chunks fall
    into partitions by chance. ``tie`` orders equal arrivals.
    """
    merged = with_inherited(
        in_chunks(df.withColumn("_seen", F.col(time)), arrival, chunks or 4 * spread(df, None)),
        [],
        {"_latest": F.max(time)},
        {"_seen": F.max("_latest").over(earlier_chunks([]))},
    )
    order = [IS_ROW, arrival, *([tie] if tie else [])]
    before = Window.partitionBy(CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = merged.withColumn("seen_until", F.max("_seen").over(before))
    return only_rows(seen.where(F.col(time) < F.col("seen_until") - interval(delay)), "_seen")


def drift_alarms(
    df: DataFrame, key: str, time: str, order: str, value: str, target: str, slack: float, bound: float,
    chunks: int | None = None,
) -> DataFrame:
    """Events at which a key's upward cumulative sum passes ``bound``.

    The sum is s = max(0, s + value - target - slack), which equals the running total less
    its least value so far, so running sums and minima give it for all events at once.
    """
    w = Window.partitionBy(key, CHUNK).orderBy(time, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = df.where(F.col(key).isNotNull()).withColumn("_step", F.col(value) - F.col(target) - F.lit(slack))
    rows = (
        in_chunks(steps, time, chunks)
        .withColumn("_run", F.sum("_step").over(w))
        .withColumn("_run_low", F.min("_run").over(w))
    )
    earlier = earlier_chunks([key])
    inherited = (
        rows.groupBy(key, CHUNK)
        .agg(F.sum("_step").alias("_total"), F.min("_run").alias("_low"))
        .withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)))
        .withColumn("_floor", F.least(F.lit(0.0), F.min(F.col("_base") + F.col("_low")).over(earlier)))
        .select(key, CHUNK, "_base", "_floor")
    )
    total = F.col("_base") + F.col("_run")
    drift = total - F.least(F.col("_floor"), F.col("_base") + F.col("_run_low"))
    return (
        rows.join(inherited, [key, CHUNK])
        .withColumn("drift", F.round(drift, 6))
        .where((F.col("drift") > bound) & (F.round(F.col("drift") - F.col("_step"), 6) <= bound))
        .select(*df.columns, "drift")
    )
