from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from vigilark.operators import events as ops
from vigilark.operators import threads

T0 = dt.datetime(2024, 1, 1)

START = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, u string, t timestamp_ntz, v double"


def at(hours: float) -> dt.datetime:
    return START + dt.timedelta(hours=hours)


def feed(seed, n=400, hours=96, step=0.5):
    """Events with tied times; one user has half of them."""
    r = random.Random(seed)
    return [(i, r.choice(["hot", "hot", "a", "b"]), at(step * r.randint(0, int(hours / step))), round(r.random() * 20, 2)) for i in range(n)]


def test_properties(spark):
    data = [(1, '{"k": 5}'), (2, '{"k": "x"}'), (3, "{broken"), (4, None), (5, '{"j": 1}')]
    got = ops.parse_props(spark.createDataFrame(data, "id int, props string"), "props", {"k": "bigint"})
    assert rows(got, "id", "k", "malformed") == [
        (1, 5, False), (2, None, True), (3, None, True), (4, None, False), (5, None, False)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_sessions_equal_brute_force(spark, seed):
    data, gap = feed(seed, n=120), dt.timedelta(hours=1.5)
    want = []
    for u in {d[1] for d in data}:
        mine = sorted((t, v) for _, x, t, v in data if x == u)
        current = [mine[0]]
        for event in mine[1:]:
            if event[0] - current[-1][0] > gap:
                want.append((u, current[0][0], current[-1][0] + gap, len(current)))
                current = []
            current.append(event)
        want.append((u, current[0][0], current[-1][0] + gap, len(current)))
    got = ops.sessions(spark.createDataFrame(data, SCHEMA), "u", "t", "v", "90 minutes")
    assert rows(got, "u", "session_start", "session_end", "n_events") == sorted(want)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("within", [None, "7 hours"])
def test_as_of_equals_brute_force(spark, forward, within):
    left, right = feed(1, 150), feed(2, 60)
    sign = 1 if forward else -1
    want = []
    for i, u, t, _ in left:
        near = [(sign * (s - t), sign * j, j) for j, x, s, _ in right if x == u and sign * (s - t) >= dt.timedelta(0)]
        best = min(near, default=None)
        if best and within and best[0] > dt.timedelta(hours=7):
            best = None
        want.append((i, best[2] if best else None))
    got = ops.as_of(
        spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "u", "t", "id",
        {"id": "match"}, forward=forward, within=within,
    )
    assert rows(got, "id", "match") == sorted(want, key=lambda w: w[0])


def test_as_of_keeps_rows_without_key_or_time(spark):
    left = spark.createDataFrame([(1, None, at(1), 0.0), (2, "a", None, 0.0), (3, "a", at(1), 0.0)], SCHEMA)
    right = spark.createDataFrame([(7, None, at(0), 0.0), (8, "a", at(0), 0.0), (9, "a", None, 0.0)], SCHEMA)
    assert rows(ops.as_of(left, right, "u", "t", "id", {"id": "m"}), "id", "m") == [(1, None), (2, None), (3, 8)]
    assert rows(ops.as_of(left, right, "u", "t", "id", {"id": "m"}, forward=True), "id", "m") == [(1, None), (2, None), (3, None)]


@pytest.mark.parametrize("chunks", [1, 4, 50])
def test_late_events_equal_brute_force(spark, chunks):
    r = random.Random(chunks)
    data = [(i, "a", at(i / 4 - r.choice([0, 0, 0, 3, 9])), 0.0) for i in range(200)]
    want, seen = [], None
    for i, _, t, _ in data:
        if seen and t < seen - dt.timedelta(hours=6):
            want.append((i, seen))
        seen = max(seen, t) if seen else t
    got = ops.late_events(spark.createDataFrame(data, SCHEMA), "id", "t", "6 hours", chunks=chunks)
    assert want and rows(got, "id", "seen_until") == want


@pytest.mark.parametrize("seed", range(3))
def test_drift_equals_the_recursion(spark, seed):
    data = feed(seed, n=300)
    want = []
    for u in {d[1] for d in data}:
        s = 0.0
        for t, i, v in sorted((t, i, v) for i, x, t, v in data if x == u):
            before, s = s, max(0.0, s + v - 10.0 - 0.5)
            if round(s, 6) > 25 >= round(before, 6):
                want.append((i, pytest.approx(s)))
    df = spark.createDataFrame(data, SCHEMA).withColumn("target", F.lit(10.0))
    got = ops.drift_alarms(df, "u", "t", "id", "v", "target", 0.5, 25.0)
    assert want and rows(got, "id", "drift") == sorted(want, key=lambda w: w[0])


def test_rolling_anomalies_need_spread(spark):
    data = [("flat", at(i), 5) for i in range(10)] + [("spike", at(i), 5 + i % 2) for i in range(9)] + [("spike", at(9), 50)]
    got = ops.rolling_anomalies(spark.createDataFrame(data, "g string, t timestamp_ntz, n int"), ["g"], "t", "n", 8, 3.0)
    assert rows(got, "g", "n") == [("spike", 50)]


def test_alerts_by_rule(spark):
    windows = ops.windowed_counts(
        spark.createDataFrame([(1, "a", at(0.1), 5.0), (2, "a", at(0.2), 5.0), (3, "b", at(0.3), 1.0)], SCHEMA), "t", ["u"], "v", "1 hour"
    )
    rules = spark.createDataFrame(
        [("r1", "a", "n_events", 1.0), ("r2", "a", "total_value", 10.0), ("r3", "b", "total_value", 0.5)],
        "rule_id string, u string, metric string, bound double",
    )
    assert rows(ops.threshold_alerts(windows, rules, "u"), "rule_id", "measured") == [("r1", 2.0), ("r3", 1.0)]


def test_first_reports_and_enrichment(spark):
    df = spark.createDataFrame([(2, "a", at(1), 1.0), (1, "a", at(1), 2.0), (3, None, at(0), 3.0)], SCHEMA)
    assert rows(ops.first_reports(df, ["u"], ["t", "id"]), "u", "id", "v") == [(None, 3, 3.0), ("a", 1, 2.0)]
    users = spark.createDataFrame([("a", "x")], "u string, name string")
    assert rows(ops.enrich(df, users, "u"), "id", "name") == [(1, "x"), (2, "x"), (3, None)]


def test_previous_crosses_chunks(spark):
    data = [(c, i, f"r{i % 3}") for c in (1, None) for i in range(10)]
    got = threads.with_previous(spark.createDataFrame(data, "c int, i bigint, role string"), "c", "i", "role", chunks=4)
    want = [(c, i, f"r{(i - 1) % 3}" if i else None) for c in (None, 1) for i in range(10)]
    assert rows(got, "c", "i", "previous") == want


def test_alerts_on_any_numeric_column(spark):
    windows = spark.createDataFrame([("a", 0, 1, 2, 3.0, 99)], "g string, window_start int, window_end int, n_events int, total_value double, third int")
    rules = spark.createDataFrame([("r", "a", "third", 1.0), ("s", "a", "n_events", 5.0)], "rule_id string, g string, metric string, bound double")
    found = ops.threshold_alerts(windows, rules, "g", ["n_events", "total_value", "third"])
    assert rows(found, "rule_id", "measured") == [("r", 99.0)]
    with pytest.raises(ValueError, match="fourth"):
        ops.threshold_alerts(windows, rules.withColumn("metric", F.lit("fourth")), "g")


def test_a_null_time_is_not_the_first_report(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 7, 3), ("b", None, 4)], "k string, t int, id int")
    assert rows(ops.first_reports(df, ["k"], ["t", "id"]), "k", "t", "id") == [("a", 5, 2), ("b", None, 4)]


def test_text_after_the_json_is_malformed(spark):
    df = spark.createDataFrame([('{"k":1} xyz',), ('{"k":1}',), ('{"k":"x"}',), ("{bad",), ("",), (None,)], "p string")
    got = {r["p"]: r["malformed"] for r in ops.parse_props(df, "p", {"k": "bigint"}).collect()}
    assert got == {'{"k":1} xyz': True, '{"k":1}': False, '{"k":"x"}': True, "{bad": True, "": True, None: False}


def test_all_followers_equal_all_pairs(spark):
    rng = random.Random(5)
    make = lambda n, o: [(rng.choice([None, 1, 1, 1, 2]), rng.choice([None, *[T0 + dt.timedelta(minutes=rng.randrange(600))] * 4]), o + i) for i in range(n)]
    left, right = make(60, 0), make(60, 1000)
    for kind in ("timestamp_ntz", "timestamp"):
        shape = f"u int, t {kind}, id int"
        got = ops.followers_within(spark.createDataFrame(left, shape), spark.createDataFrame(right, shape), "u", "t", {"id": "other", "t": "then"}, "1 hour 30 minutes")
        hour = dt.timedelta(minutes=90)
        want = [(a[2], b[2]) for a in left for b in right if None not in (*a, *b) and a[0] == b[0] and a[1] <= b[1] <= a[1] + hour]
        assert rows(got, "id", "other") == sorted(want) and got.columns == ["u", "t", "id", "other", "then"]
    with pytest.raises(ValueError):
        ops.followers_within(spark.createDataFrame(left, shape), spark.createDataFrame(right, shape), "u", "t", {}, "soon")


def test_only_the_borders_of_a_chunk_are_merged(spark):
    """One user, sessions of a few seconds: the window over the user sees two pieces a chunk."""
    times = [T0 + dt.timedelta(seconds=10 * i + (i % 3)) for i in range(2000)]
    df = spark.createDataFrame([(1, t, 1.0) for t in times], "u int, t timestamp_ntz, v double")
    got = ops.sessions(df, "u", "t", "v", "9 seconds", chunks=8)
    want, last = [], None
    for t in sorted(times):
        if last is None or t - last > dt.timedelta(seconds=9):
            want.append([t, 0])
        want[-1][1] += 1
        last = t
    assert rows(got, "session_start", "n_events") == [tuple(w) for w in want] and len(want) > 500
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "_edge" in plan


def test_more_than_one_json_value_is_malformed(spark):
    wrong = ['{"k":1} {"k":2}', '{"k":1} xyz}', '{"k":1}}', "7 8", '{"k":1}] {}', '{"k":1}, "b":2', '{"k":1}, 2', '{"k":1}} {', "1, null", '"a" "b"']
    right = ['{"k":1}', ' {"k": "}"} ', "[1, 2]", "7", "null", '{"k":{"k":[{}]}}', '"a, b"']
    df = spark.createDataFrame([(x,) for x in wrong + right], "p string")
    got = {r["p"]: r["malformed"] for r in ops.parse_props(df, "p", {"z": "bigint"}).collect()}
    assert got == {x: x in wrong for x in wrong + right}
