from __future__ import annotations

import heapq
import random
from fractions import Fraction

from pyspark.sql import functions as F

from vigilark.llm import apportion


def water_fill(sizes, weights, stop):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    target, open_, rest = {}, set(sizes), Fraction(sum(sizes.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > stop * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = Fraction(stop * sizes[s])
            rest -= target[s]
        open_ -= over
    return target


def highest_quotients(weights, seats, most):
    got = dict.fromkeys(weights, 0)
    heap = [(-Fraction(w), k) for k, w in weights.items() if w > 0]
    heapq.heapify(heap)
    while seats and heap:
        _, k = heapq.heappop(heap)
        if got[k] < most[k]:
            got[k] += 1
            seats -= 1
            heapq.heappush(heap, (-Fraction(weights[k]) / (2 * got[k] + 1), k))
    return got


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target string")


def test_quotas_are_those_of_the_highest_quotients(spark):
    rng = random.Random(5)
    for n, seats in ((1, 7), (6, 3), (9, 1000), (40, 57), (5, 0)):
        weights = {f"s{i:02}": rng.choice([0, 1, 2, 2, 50, 1000]) + 1 for i in range(n)}
        df = spark.createDataFrame([(k, float(w), seats, 10**6, "g") for k, w in weights.items()], "k string, w double, seats long, most long, g string")
        want = highest_quotients(weights, seats, dict.fromkeys(weights, 10**6))
        for groups in ([], ["g"]):
            got = {r["k"]: r["quota"] for r in apportion.sainte_lague(df, groups, ["k"], "w", "seats", "most").collect()}
            assert got == want


def test_targets_and_taken_words(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(["w"] * n)
    rows = [(i, text(rng.randrange(0, 400)), rng.choice(["a", "b", "c", None, "é", "z"] + ["hot"] * 3), "x", "y") for i in range(600)]
    rows += [(1000, None, "a", "", ""), (1001, text(30_000), "hot", "", ""), (None, text(9), "tiny", "", ""), (5, text(50), "b", "", ""), (5, text(50), "b", "", ""), (7, "", "blank", "", "")]
    got = apportion.mix(docs_of(spark, rows), shard_words=5000, keep=("source",)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water_fill(sizes, (5, 2, 1), 3)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - float(want[r["source"]])) < 1e-6
        assert r["taken"] <= 3 * r["size"]
        assert r["taken"] == sum(t * (b - a) for t, a, b in r["spans"])
        assert all(0 <= a < b <= r["size"] for _, a, b in r["spans"])
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - float(want[s])) <= max(64, 0.02 * float(want[s])), (s, n, float(want[s]))


def test_reruns_agree_and_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = apportion.mix(docs).select("doc_id", "taken")
    b = apportion.mix(docs.repartition(7)).select("doc_id", "taken")
    assert a.exceptAll(b).isEmpty()
    total = apportion.mix(docs).agg(F.sum("size").alias("a"), F.sum("taken").alias("b")).first()
    assert abs(total["a"] - total["b"]) <= 0.02 * total["a"]
    assert apportion.mix(docs.limit(0)).collect() == []


def test_many_small_sources_get_their_share(spark):
    rng = random.Random(9)
    sizes = {f"s{i:04}": rng.randrange(5, 51) for i in range(400)} | {"large": 20_000}
    rows = [(i, " ".join(f"w{j}" for j in range(n // 2 + n % 2 * k)), s, "x", "y") for i, (s, n) in enumerate(sizes.items()) for k in (0, 1)]
    got = apportion.mix(docs_of(spark, rows), keep=("source",)).collect()
    found = {}
    for _, t, s, *_ in rows:
        found[s] = found.get(s, 0) + len(t.split())
    want, taken = water_fill(found, (5, 2, 1), 3), dict.fromkeys(found, 0)
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - float(want[s])) <= max(1.01, 0.02 * float(want[s])) for s in taken)
    assert sum(taken.values()) >= 0.99 * sum(found.values())
