from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from vigilark.operators import neighbours as m
from vigilark.operators.entities import top_k_per_group
from vigilark.registry import texts

SHAPE = "id long, v array<float>"


def clustered(n, groups, dim, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    return (centres[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, dim))).astype(np.float32)


def brute(ids, vectors, k, least=-2.0):
    """{id: [(neighbour, similarity)]} for every fifth id, by all pairs."""
    v = np.array(vectors, np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i, key in enumerate(ids):
        if key % 5 == 0:
            s = np.round(v @ v[i], 9)
            near = sorted((-x, other) for x, other in zip(s, ids) if other != key and x >= least)[:k]
            out[key] = [(other, -x) for x, other in near]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["position"])):
        out.setdefault(r["id"], []).append((r["neighbour"], r["similarity"]))
    return out


def same(got, want):
    assert got.keys() == {q for q, w in want.items() if w}
    for q, near in got.items():
        assert [n for n, _ in near] == [n for n, _ in want[q]]
        assert [s for _, s in near] == pytest.approx([s for _, s in want[q]], abs=1e-8)


def test_nearest_is_exact_and_leaves_most_blocks_out(spark):
    vectors = clustered(1500, 20, 8, 0.1, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SHAPE)
    asks = F.col("id") % 5 == 0
    same(answers(m.nearest(df, "id", "v", 8, asks, 7, part=64)), brute(range(1500), vectors, 7))
    distinct, _ = m.classes(df, "id", "v", 8, asks, 7)
    blocks = m.Blocks(distinct, 8)
    bounded = blocks.first_bound(8)
    visited, there = blocks.visits(bounded).count(), blocks.stats.count()
    assert visited < 0.35 * there * bounded.count()


def test_copies_odd_vectors_and_ties(spark):
    hot = [1.0, 2.0, 2.0]
    data = [(i, hot) for i in range(60)] + [(100 + i, [1.0, float(i % 3), 0.5]) for i in range(30)]
    odd = [(205, [0.0, 0.0, 0.0]), (210, None)]
    df = spark.createDataFrame(data + odd, SHAPE).withColumns({c: F.lit("x") for c in ("query", "unit", "part", "n", "member")})
    want = brute([i for i, _ in data], [v for _, v in data], 4)
    same(answers(m.nearest(df, "id", "v", 3, F.col("id") % 5 == 0, 4, pivots=3, part=4)), want)
    close = brute([i for i, _ in data], [v for _, v in data], 4, 0.99)
    same(answers(m.similar(df, "id", "v", 3, F.col("id") % 5 == 0, 4, 0.99, 0.999, limit=8)), close)


def test_few_rows_and_none(spark):
    none = spark.createDataFrame([], SHAPE)
    assert rows(m.nearest(none, "id", "v", 2, F.lit(True), 3)) == []
    assert rows(m.similar(none, "id", "v", 2, F.lit(True), 3, 0.5)) == []
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], SHAPE)
    assert rows(m.nearest(two, "id", "v", 2, F.lit(True), 3), "id", "neighbour", "similarity") == [(1, 2, 0.0), (2, 1, 0.0)]
    with pytest.raises(Exception, match="values, not 3"):
        m.nearest(two, "id", "v", 3, F.lit(True), 1).collect()


def recall(got, want):
    hits = sum(len({n for n, _ in got.get(q, [])} & {n for n, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("limit", [4096, 250])
def test_sign_keys_reach_their_recall(spark, limit):
    vectors = clustered(1200, 12, 16, 0.35, 2)
    vectors[300:700] = vectors[3] + 0.05 * np.random.default_rng(3).standard_normal((400, 16))  # a hot place
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SHAPE)
    want = brute(range(1200), vectors, 10, 0.8)
    got = answers(m.similar(df, "id", "v", 16, F.col("id") % 5 == 0, 10, 0.8, 0.95, limit=limit))
    assert recall(got, want) >= 0.9


def test_recall_of_the_query(spark):
    d = "/root/testdata/sf0.01"
    exact = {(r["vec_id"], r["neighbour"]) for r in texts.vector_top_k(spark, d).where("similarity >= 0.3").collect()}
    found = {(r["vec_id"], r["neighbour"]) for r in texts.vector_candidates(spark, d).collect()}
    assert found <= exact and len(found & exact) >= 0.9 * len(exact) > 0


def test_hot_buckets_are_parted(spark):
    vectors = clustered(800, 1, 16, 0.8, 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SHAPE)
    distinct, _ = m.classes(df, "id", "v", 16, F.lit(True), 3)
    rows_in = lambda limit: m.sign_buckets(distinct, 16, 0.8, 0.95, limit)
    whole, parted = rows_in(10_000), rows_in(50)
    before = whole.where("n > 50").agg(F.avg("n")).first()[0]
    after = parted.join(whole.select("bucket").distinct(), "bucket", "left_anti").agg(F.avg("n")).first()[0]
    # A vector of a hot bucket goes to a few smaller buckets, and no vector is lost.
    assert after < 0.8 * before, (before, after)
    assert parted.select("id").distinct().count() == 800


def test_blocks_of_queries_and_vectors_give_the_same(spark):
    vectors = np.random.default_rng(5).standard_normal((600, 6)).astype(np.float32)
    vectors[200:260] = vectors[0] * np.arange(1, 61)[:, None]  # other lengths: ties of distinct vectors
    vectors[7] = np.nan
    df = spark.createDataFrame([(f"{i:03}", v.tolist()) for i, v in enumerate(vectors)], "id string, v array<float>")
    asks = F.col("id").cast("int") % 5 == 0
    ids = [i for i in range(600) if i != 7]
    for got, least in ((m.nearest(df, "id", "v", 6, asks, 6, part=50), -2.0), (m.similar(df, "id", "v", 6, asks, 6, 0.5), 0.5)):
        assert got.schema["id"].dataType == df.schema["id"].dataType
        same(answers(got.withColumns({c: F.col(c).cast("int") for c in ("id", "neighbour")})), brute(ids, vectors[ids], 6, least))


def test_vectors_of_a_query_are_compared_as_matrices(spark, monkeypatch):
    """Pair by pair in Spark's expressions, two million pairs take minutes."""
    df = spark.createDataFrame([(i, [1.0, float(i), float(i * i % 7)]) for i in range(40)], SHAPE)
    plans = []
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(m, "top_k_per_group", lambda d, *a: plans.append(plan(d)) or top_k_per_group(d, *a))
    m.nearest(df, "id", "v", 3, F.col("id") % 5 == 0, 3)
    m.similar(df, "id", "v", 3, F.col("id") % 5 == 0, 3, 0.3)
    assert sum("FlatMapCoGroupsInArrow" in p for p in plans) == 2


@pytest.mark.parametrize("limit", [4096, 250])
def test_sign_keys_reach_their_recall_where_they_are_chosen(spark, limit):
    vectors = clustered(1200, 12, 16, 0.35, 2)
    vectors[300:700] = vectors[3] + 0.05 * np.random.default_rng(3).standard_normal((400, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SHAPE)
    got = answers(m.similar(df, "id", "v", 16, F.col("id") % 5 == 0, 10, 0.8, 0.95, limit=limit, by_signs=True))
    assert recall(got, brute(range(1200), vectors, 10, 0.8)) >= 0.9


def test_keys_are_chosen_where_they_are_less_work():
    assert not m.keys_pay(600_000, 12_000, 0.3, 0.975) and not m.keys_pay(10**9, 2 * 10**7, 0.3, 0.975)
    assert m.keys_pay(10**7, 10**7, 0.9, 0.975)
