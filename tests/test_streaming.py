"""Streams against the batch form of the same operators, and their own cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from vigilark.operators import events as ops
from vigilark.sources.scan import stream_scan
from vigilark.sources.tables import schema_of, table
from vigilark.streaming import sinks, state

DATA = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


def at(hours: float) -> dt.datetime:
    return START + dt.timedelta(hours=hours)


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Each shuffle partition holds a state store; the small streams here need few."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """The events in four files, in order of arrival."""
    path = str(tmp_path_factory.mktemp("feed"))
    events = table(spark, DATA, "events")
    for i in range(4):
        part = events.where(F.floor(F.col("event_id") / 250) == i)
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def events_of(spark, feed, delay="1 hour"):
    scan = stream_scan(spark, feed, schema_of("events"), files_per_batch=1)
    return state.watermarked(scan, "ts", delay)


def run(df, name, mode, tmp_path):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    assert query.exception() is None
    return df.sparkSession.table(name)


def small_feed(spark, path, batches, schema="id bigint, key bigint, ts timestamp, value double"):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{path}")
    return schema


def test_windowed_counts_stream_equals_batch(spark, feed, tmp_path):
    streamed = run(
        ops.windowed_counts(events_of(spark, feed), "ts", ["event_type"], "value", "1 hour"), "tumbling", "complete", tmp_path
    )
    batch = ops.windowed_counts(table(spark, DATA, "events"), "ts", ["event_type"], "value", "1 hour")
    names = ["window_start", "event_type", "n_events"]
    as_ntz = lambda df: df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    assert rows(as_ntz(streamed), *names) == rows(batch, *names)


def test_sessions_stream_equals_batch(spark, feed, tmp_path):
    """Append emits a session once the watermark has passed it; all emitted ones are in the batch result."""
    streamed = rows(run(ops.sessions(events_of(spark, feed), "user_id", "ts", "value", "6 hours"), "sessions", "append", tmp_path),
                    "user_id", F.col("session_start").cast("timestamp_ntz"), "n_events")
    batch = rows(ops.sessions(table(spark, DATA, "events"), "user_id", "ts", "value", "6 hours"),
                 "user_id", "session_start", "n_events")
    assert set(streamed) <= set(batch) and len(streamed) > 0.9 * len(batch)


def test_alerts_and_enrichment_stream(spark, feed, tmp_path):
    rules = spark.createDataFrame([("busy", "click", "n_events", 1.0)], "rule_id string, event_type string, metric string, bound double")
    hourly = ops.windowed_counts(events_of(spark, feed), "ts", ["event_type"], "value", "1 hour")
    streamed = run(ops.threshold_alerts(hourly, rules, "event_type"), "alerts", "append", tmp_path)
    batch = ops.threshold_alerts(
        ops.windowed_counts(table(spark, DATA, "events"), "ts", ["event_type"], "value", "1 hour"), rules, "event_type"
    )
    got = rows(streamed, F.col("window_start").cast("timestamp_ntz"), "measured")
    assert got and set(got) <= set(rows(batch, "window_start", "measured"))
    users = spark.createDataFrame([(1, "a")], "user_id bigint, name string")
    known = run(ops.enrich(events_of(spark, feed), users, "user_id"), "enriched", "append", tmp_path)
    assert known.count() == 1000 and known.where("name is not null").count() == known.where("user_id = 1").count()


def test_parsed_properties_stream(spark, feed, tmp_path):
    parsed = run(ops.parse_props(events_of(spark, feed), "props", {"k": "bigint"}), "parsed", "append", tmp_path)
    assert rows(parsed, "event_id", "k") == rows(
        ops.parse_props(table(spark, DATA, "events"), "props", {"k": "bigint"}), "event_id", "k"
    )


def test_windowed_join(spark, feed, tmp_path):
    def of(kind):
        return ops.windowed_counts(
            events_of(spark, feed).where(F.col("event_type") == kind), "ts", ["event_type"], "value", "1 day"
        ).select("window_start", "window_end", F.col("n_events").alias(kind))

    joined = run(state.windowed_join(of("error"), of("purchase"), []), "joined", "append", tmp_path)
    daily = (
        table(spark, DATA, "events").groupBy(F.col("ts").cast("date").alias("day"))
        .agg(F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type") == "purchase"))
    )
    got = rows(joined, F.col("window_start").cast("date"), "error", "purchase")
    assert len(got) > 20 and set(got) <= set(rows(daily))


def test_deduplication_keeps_first_and_forgets_after_the_delay(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = small_feed(spark, path, [
        [(1, 7, at(0), 1.0), (2, 7, at(0.2), 1.0)],
        [(3, 7, at(0.5), 1.0), (4, 8, at(0.5), 1.0)],
        [(5, 9, at(30), 1.0)],
        [(6, 10, at(30.2), 1.0)],  # state is dropped at the end of the batch after the watermark moved
        [(7, 7, at(30.5), 1.0)],
    ])
    scan = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    kept = run(state.deduplicate_events(state.watermarked(scan, "ts", "1 hour"), ["key"]), "deduplicated", "append", tmp_path)
    ids = [r[0] for r in rows(kept, "id")]
    assert ids in ([1, 4, 5, 6, 7], [2, 4, 5, 6, 7])  # within one file either repeat may come first


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, state.ROCKSDB)
    yield
    spark.conf.set(name, before)


def test_drift_stream_equals_batch(spark, feed, tmp_path, rocksdb):
    events = events_of(spark, feed).select("event_id", "user_id", "ts", "value").withColumn("target", F.lit(40.0))
    args = ("user_id", "ts", "event_id", "value", "target", 5.0, 60.0)
    streamed = run(state.drift_state(events, *args), "drift", "append", tmp_path)
    batch = ops.drift_alarms(
        table(spark, DATA, "events").select("event_id", "user_id", "ts", "value").withColumn("target", F.lit(40.0)), *args
    )
    got = rows(streamed, "event_id", "drift")
    assert got and got == rows(batch, "event_id", "drift")


def test_drift_state_ends_when_a_key_is_silent(spark, tmp_path, rocksdb):
    path = str(tmp_path / "in")
    schema = small_feed(spark, path, [
        [(1, 1, at(0), 6.0)],
        [(2, 2, at(50), 0.0)],
        [(3, 2, at(51), 0.0)],
        [(4, 1, at(52), 6.0)],
    ])
    scan = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("target", F.lit(0.0))
    events = state.watermarked(scan, "ts", "1 hour")
    args = ("key", "ts", "id", "value", "target", 0.0, 10.0)
    assert rows(run(state.drift_state(events, *args), "kept", "append", tmp_path), "id") == [(4,)]
    day = 24 * 3600 * 1000
    assert rows(run(state.drift_state(events, *args, idle_ms=day), "ended", "append", tmp_path), "id") == []


def test_alert_sink_counts_a_repeated_batch_once_and_resumes(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "alerts", "checkpoint"))
    schema = small_feed(spark, source, [[(1, 1, at(0), 5.0), (2, 1, at(0.1), 5.0)]])

    def alerts():
        scan = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return ops.windowed_counts(state.watermarked(scan, "ts", "1 day"), "ts", ["key"], "value", "1 hour")

    keys = ["key", "window_start"]
    sinks.start_alerts(alerts(), path, checkpoint).awaitTermination(180)
    read = lambda: rows(sinks.read_alerts(spark, path, alerts().schema, keys), "key", "n_events")
    assert read() == [(1, 2)]
    small_feed(spark, source, [[(3, 1, at(0.2), 5.0), (4, 2, at(0.3), 1.0)]])
    sinks.start_alerts(alerts(), path, checkpoint).awaitTermination(180)
    assert read() == [(1, 3), (2, 1)]
    batch = spark.read.parquet(f"{path}/batch_id=0")
    sinks.alert_writer(path)(spark.createDataFrame(batch.collect(), batch.schema), 0)
    assert read() == [(1, 3), (2, 1)]


def test_followed_stream_equals_batch(spark, feed, tmp_path, rocksdb):
    events = events_of(spark, feed).where("event_type IN ('error', 'purchase')")
    marked = events.withColumn("follows", F.col("event_type") == "purchase")
    day = 24 * 3600 * 1000
    streamed = run(
        state.followed_state(marked, "user_id", "ts", "event_id", "follows", ("next_id", "next_ts"), day), "followed", "append", tmp_path
    )
    all_events = table(spark, DATA, "events")
    of = lambda kind: all_events.where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    batch = ops.as_of(of("error"), of("purchase"), "user_id", "ts", "event_id", {"event_id": "next_id"}, forward=True, within="1 day")
    got = rows(streamed, "event_id", "next_id")
    assert got and got == rows(batch.where("next_id is not null"), "event_id", "next_id")


def test_waiting_rows_are_dropped_in_time(spark, tmp_path, rocksdb):
    path = str(tmp_path / "in")
    schema = small_feed(spark, path, [
        [(1, 1, at(0), 0.0)],
        [(2, 1, at(1), 0.0), (3, 1, at(2), 1.0)],
        [(4, 1, at(3), 0.0)],
        [(5, 2, at(20), 0.0)],
        [(6, 1, at(21), 1.0)],
    ])
    scan = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    marked = state.watermarked(scan, "ts", "1 hour").withColumn("follows", F.col("value") > 0)
    found = run(state.followed_state(marked, "key", "ts", "id", "follows", ("n", "t"), 4 * 3600 * 1000), "waiting", "append", tmp_path)
    assert rows(found, "id", "n") == [(1, 3), (2, 3)]


def test_late_rows_of_a_stream_equal_the_batch(spark, tmp_path, rocksdb):
    events = table(spark, DATA, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    arrived = events.select("event_id", F.lit(1).alias("source"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") * 1000 + F.col("k") * 5000).alias("arrival"))
    arrived = arrived.unionByName(arrived.limit(3).withColumns({"ts": F.lit(None).cast("timestamp"), "event_id": F.col("event_id") + 10_000}))
    path, quarter = str(tmp_path / "in"), arrived.count() // 4
    numbered = arrived.orderBy("arrival", "event_id").collect()
    for i in range(0, len(numbered), quarter):
        spark.createDataFrame(numbered[i : i + quarter], arrived.schema).coalesce(1).write.mode("append").parquet(path)
    scan = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = rows(run(state.late_state(scan, ["source"], ["arrival", "event_id"], "ts", "6 hours"), "late", "append", tmp_path), "event_id", "seen_until")
    want = rows(ops.late_events(arrived, "arrival", "ts", "6 hours", tie="event_id"), "event_id", "seen_until")
    assert got and got == want


def test_rolling_stream_equals_the_batch_over_closed_windows(spark, feed, tmp_path, rocksdb):
    """The delay covers the disorder; the last windows stay open, so the batch is held to those the watermark has passed."""
    counts = ops.windowed_counts(events_of(spark, feed, "3 hours"), "ts", ["event_type"], "value", "1 hour")
    got = rows(run(state.rolling_state(counts, ["event_type"], "window_start", "n_events", 6, 1.0), "rolling", "append", tmp_path),
               "event_type", F.col("window_start").cast("timestamp_ntz"), F.round("z", 6))
    events = table(spark, DATA, "events")
    last = events.agg(F.max("ts")).first()[0]
    batch = ops.windowed_counts(events, "ts", ["event_type"], "value", "1 hour").where(F.col("window_end") <= F.lit(last - dt.timedelta(hours=3)).cast("timestamp_ntz"))
    want = rows(ops.rolling_anomalies(batch, ["event_type"], "window_start", "n_events", 6, 1.0), "event_type", "window_start", F.round("z", 6))
    assert got and got == want


def test_all_followers_of_a_stream_equal_the_batch(spark, feed, tmp_path):
    pick = lambda df, kind: df.where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    columns = {"event_id": "other", "ts": "then"}
    streamed = ops.followers_within(pick(events_of(spark, feed), "error"), pick(events_of(spark, feed), "purchase"), "user_id", "ts", columns, "6 hours")
    events = table(spark, DATA, "events")
    batch = ops.followers_within(pick(events, "error"), pick(events, "purchase"), "user_id", "ts", columns, "6 hours")
    got = rows(run(streamed, "followers", "append", tmp_path), "event_id", "other")
    assert got and got == rows(batch, "event_id", "other")
