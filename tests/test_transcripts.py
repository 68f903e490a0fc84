from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vigilark.operators import profiles, threads


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_parts_put_together_are_the_transcript(spark, size):
    rng = random.Random(size)
    data = [(rng.choice([None, 1, 2, 2, 2]), rng.choice([None, *range(40)]), rng.choice("ab"), rng.choice([None, "", "é", "word " * rng.randrange(9)])) for _ in range(80)]
    df = spark.createDataFrame(data, "k int, o int, role string, t string")
    got = threads.transcript_parts(df, "k", "o", "role", F.concat("role", F.lit(": "), F.col("t")), size, chunks=5)
    lines = {}
    for k, o, role, t in data:
        lines.setdefault(k, []).append((o is not None, o or 0, role, "" if t is None else f"{role}: {t}"))
    parts = {}
    for r in sorted(got.collect(), key=lambda r: r["part"]):
        parts.setdefault(r["k"], []).append((r["part"], r["text"]))
    for k, own in lines.items():
        whole = "\n".join(x[3] for x in sorted(own))
        assert "".join(t for _, t in parts[k]) == whole
        assert [p for p, _ in parts[k]] == list(range(len(parts[k]))) and all(len(t) == size for _, t in parts[k][:-1])


def test_a_long_thread_is_in_many_chunks_and_odd_threads(spark):
    long = spark.range(3000).selectExpr("1 as k", "id as o", "'a' as role", "repeat('x', 50) as t")
    got = threads.transcript_parts(long, "k", "o", "role", F.col("t"), 500)
    assert got.count() == -(-(3000 * 51 - 1) // 500)
    assert threads.transcript_parts(long.limit(0), "k", "o", "role", F.col("t"), 5).count() == 0
    assert threads.transcript_parts(long.limit(1).withColumn("t", F.lit(None).cast("string")), "k", "o", "role", F.col("t"), 5).where("text <> ''").count() == 0


def test_sketches_of_days_give_the_quantiles_of_all(spark):
    df = spark.range(20_000).selectExpr("id % 2 as g", "id % 10 as day", "case when id % 3 = 0 then 7.0 else cast(id as double) end as v")
    daily = profiles.quantile_sketches(df, ["g", "day"], "v", parts=3)
    assert daily.count() == 10
    found = profiles.sketched_quantiles(profiles.merge_quantile_sketches(daily, ["g"]), ["g"], [0.0, 0.3, 0.5, 1.0])
    checked = profiles.rank_errors(df, ["g"], "v", found).collect()
    assert len(checked) == 8 and all(r["within"] and r["n"] == 10_000 for r in checked)
    wrong = profiles.rank_errors(df, ["g"], "v", found.withColumn("estimate", F.col("estimate") + 5000))
    assert wrong.where("not within").count() >= 4
    nothing = profiles.quantile_sketches(df.withColumn("v", F.lit(None).cast("double")), ["g"], "v")
    assert nothing.count() == 0
