from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import rows
from vigilark.operators import entities as ops
from vigilark.operators import profiles, rules
from vigilark.plans.chunked import value_ranks


def skewed(seed, n=600):
    """(id, group, value): one group holds a third or more, one group is null, values tie, some are null."""
    r = random.Random(seed)
    return [
        (i, r.choice(["hot", "hot", "hot", "a", "b", None]), None if r.random() < 0.05 else float(r.choice([0, 0, r.randint(-50, 50), r.random()])))
        for i in range(n)
    ]


def frame(spark, data):
    return spark.createDataFrame(data, "id bigint, g string, v double")


@pytest.mark.parametrize("chunks", [2, 3, 7, 40])
def test_value_ranks_equal_brute_force(spark, chunks):
    data = skewed(chunks)
    want = []
    for g in {d[1] for d in data}:
        values = [v for _, h, v in data if h == g and v is not None]
        group = (len(values), min(values), max(values), round(statistics.mean(values), 9), round(statistics.stdev(values), 9))
        want += [(g, v, values.count(v), sum(x < v for x in values), *group) for v in set(values)]
    got = value_ranks(frame(spark, data), ["g"], "v", chunks)
    got = got.withColumns({"mean": F.round("mean", 9), "deviation": F.round("deviation", 9)})
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("chunks", [2, 5, 40])
def test_quantiles_equal_brute_force(spark, chunks):
    data = skewed(10 + chunks)
    fractions = [0.0, 0.1, 0.5, 0.95, 1.0]
    want = {}
    for g in {d[1] for d in data}:
        values = sorted(v for _, h, v in data if h == g and v is not None)
        for f in fractions:
            at = f * (len(values) - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            want[g, f] = low + (high - low) * (at - math.floor(at))
    got = profiles.quantile_profile(frame(spark, data), ["g"], "v", fractions, chunks=chunks)
    found = {(r["g"], r["fraction"]): r["quantile"] for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_quantiles_of_no_rows_and_of_one_value(spark):
    empty = frame(spark, [])
    assert profiles.quantile_profile(empty, ["g"], "v", [0.5]).count() == 0
    same = frame(spark, [(i, "a", 3.0) for i in range(9)])
    assert rows(profiles.quantile_profile(same, ["g"], "v", [0.25, 1.0])) == [("a", 0.25, 3.0), ("a", 1.0, 3.0)]


def test_approximate_quantiles_are_values_of_the_group(spark):
    data = [(i, "a", float(i)) for i in range(101)]
    got = rows(profiles.quantile_profile(frame(spark, data), ["g"], "v", [0.1, 0.9], approximate=True))
    assert got == [("a", 0.1, 10.0), ("a", 0.9, 90.0)]


def test_normalised_metric_without_spread_and_with_nulls(spark):
    data = [(1, "a", 5.0), (2, "a", 5.0), (3, "b", 1.0), (4, "b", 3.0), (5, "b", None), (6, None, 2.0)]
    got = ops.normalise_metric(frame(spark, data), ["g"], "v")
    assert rows(got, "id", "v_min_max", "v_pct_rank") == [
        (1, None, 0.0), (2, None, 0.0), (3, 0.0, 0.0), (4, 1.0, 1.0), (5, None, None), (6, None, 0.0)
    ]
    z = dict(rows(got, "id", "v_z_score"))
    assert z[1] is None and z[6] is None and z[3] == pytest.approx(-math.sqrt(0.5))


def test_composite_score_rescales_weights(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, None, 0.5), (3, None, None)], "id int, a double, b double")
    got = dict(rows(ops.composite_score(df, {"a": 0.25, "b": 0.75}), "id", "score"))
    assert got == {1: 0.25, 2: 0.5, 3: None}


def test_coverage_ignores_null_keys(spark):
    entities = spark.createDataFrame([(1,), (2,), (None,)], "e int")
    facts = spark.createDataFrame([(1,), (1,), (None,)], "f int")
    assert rows(ops.covered_entities(entities, facts, "e", "f")) == [(1,)]
    assert rows(ops.uncovered_entities(entities, facts, "e", "f")) == [(None,), (2,)]


def test_rollup_tells_null_members_from_totals(spark):
    totals = spark.createDataFrame([("x", None, 1), ("x", "m", 2)], "a string, b string, n int")
    assert rows(ops.hierarchy_rollup(totals, ["a", "b"], ["n"]), "a", "b", "level_id", "n") == [
        (None, None, 3, 3), ("x", None, 0, 1), ("x", None, 1, 3), ("x", "m", 0, 2)
    ]


def test_cube_and_sets_add_up(spark):
    facts = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 4.0)], "p string, q string, v double")
    cube = ops.cross_cube(facts, ["p", "q"], {"v": F.col("v")})
    assert cube.count() == 3 + 2 + 2 + 1 and rows(cube.where("level_id = 3"), "v") == [(7.0,)]
    sets = ops.chosen_sets(facts, [["q"], []], ["p", "q"], {"v": F.col("v")})
    assert rows(sets, "q", "v") == [(None, 7.0), ("x", 5.0), ("y", 2.0)]


def test_exposure_and_concentration(spark):
    facts = spark.createDataFrame(
        [("s", "e1", 3.0, 1.0), ("s", "e2", 1.0, None), ("t", "e1", 0.0, 1.0)], "g string, e string, amount double, score double"
    )
    assert rows(ops.weighted_exposure(facts, ["g"], "amount", "score")) == [("s", 4.0, 1.0), ("t", 0.0, None)]
    assert rows(ops.concentration(facts, ["g"], "e", "amount")) == [("s", 2, 0.625), ("t", 1, None)]


def test_top_k_breaks_ties_by_key(spark):
    df = frame(spark, [(3, "a", 1.0), (1, "a", 1.0), (2, "a", 1.0), (4, "b", 0.0)])
    got = ops.top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 2)
    assert rows(got, "g", "position", "id") == [("a", 1, 1), ("a", 2, 2), ("b", 1, 4)]


def test_repeated_keys_count_null_versions(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (2, "x")], "k int, v string")
    assert rows(ops.repeated_keys(df, ["k"], ["v"])) == [(1, 3, 2)]


def test_rule_metrics_against_counting(spark):
    data = [(5.0, True), (15.0, False), (15.0, True), (25.0, True), (None, True)]
    got = rules.rule_metrics(spark.createDataFrame(data, "s double, a boolean"), "s", "a", 10.0)
    names = ["threshold", "true_positive", "false_positive", "false_negative", "true_negative"]
    assert rows(got, *names) == [(0.0, 3, 1, 0, 0), (10.0, 2, 1, 1, 0), (20.0, 1, 0, 2, 1)]
    assert rows(got.where("threshold = 20"), "precision", "recall", "f1") == [(1.0, pytest.approx(1 / 3), 0.5)]


def test_sketches_merge(spark):
    df = spark.createDataFrame([(d, u) for d in range(3) for u in range(d * 10, d * 10 + 50)], "day int, u int")
    merged = profiles.merge_sketches(profiles.distinct_sketch(df, ["day"], "u").withColumn("all", F.lit(1)), ["all"])
    assert abs(merged.first()["n_distinct_estimate"] - 70) <= 2


def test_column_profile_counts_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (None, "a")], "x int, y string")
    assert rows(profiles.column_profile(df, ["x", "y"])) == [("x", 3, 1, "1", "2"), ("y", 3, 1, "a", "b")]


def test_many_metrics_equal_one_at_a_time(spark):
    data = [(i, "a" if i % 3 else None, float(i % 4) if i % 5 else None, i % 7) for i in range(60)]
    df = spark.createDataFrame(data, "id int, g string, x double, y int")
    got = ops.normalise_metrics(df, "id", ["g"], ["x", "y"], chunks=4)
    one = ops.normalise_metric(ops.normalise_metric(df, ["g"], "x"), ["g"], "y")
    names = ["id", *[f"{m}_{k}" for m in "xy" for k in ("min_max", "z_score", "pct_rank")]]
    assert got.columns == names
    plain = lambda d: [tuple(v if v is None else round(v, 9) for v in r) for r in rows(d.select(names))]
    assert [r for r in plain(got) if r[1] is not None] == [r for r in plain(one) if r[1] is not None]
    scans = lambda metrics: ops.normalise_metrics(df, "id", ["g"], metrics)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert scans(["x"]) == scans(["x", "y"])
