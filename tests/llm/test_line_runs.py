from __future__ import annotations

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from vigilark.llm import line_runs as m
from vigilark.llm.registry import QUERIES, SQL

SHAPE = "doc_id long, text string"


def key_of(line):
    stripped = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in stripped)


def plain(rows, enough=3, least=20):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key_of(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")

        def stays(line):
            k = key_of(line)
            docs = holders[k]
            return len(k) < least or len(docs) < enough or doc == max((d for d in docs if d is not None), default=None)

        kept = [line for line in lines if stays(line)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)


def test_query_equals_sql(spark):
    df = QUERIES["op11_line_runs"](spark, "/root/testdata/sf0.01")
    assert difference(df, connect("/root/testdata/sf0.01"), SQL["op11_line_runs"]) is None
    assert df.agg(F.sum("n_dropped")).first()[0] > 0
    assert spark.catalog.listTables() == []


@pytest.mark.parametrize("batches,fan", [(1, 2), (5, 2), (4, 4)])
def test_odd_rows_equal_the_plain_version(spark, batches, fan):
    rng = random.Random(batches)
    base = ["A line of twenty chars", "a LINE of twenty chars", "\x0b another long enough line\t", "short", "", " ", "É" * 20, "é" * 20, "é" * 19, "ü" * 12, "x" * 20, "x" * 19, "y" * 3000]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "\n", "\n".join(rng.choice(base) for _ in range(rng.randrange(1, 9)))])) for _ in range(200)]
    rows += rows[:10] + [(99, "z" * 50 + "\n") for _ in range(5)] + [(100, "\n".join(["a line of twenty chars"] * 4000))]
    df = spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit("x") for c in ("doc", "line", "batch", "gone", "n", "keeper", "text_hash", "kept_text")})
    assert found(m.drop_repeated_lines(df, batches=batches, fan=fan)) == plain(rows)


def test_no_rows_and_rows_without_ids(spark):
    none = spark.createDataFrame([], SHAPE)
    assert found(m.drop_repeated_lines(none, batches=2)) == []
    rows = [(None, f"the very same long line\n{k}") for k in range(5)]
    assert found(m.drop_repeated_lines(spark.createDataFrame(rows, SHAPE), batches=2)) == plain(rows)


def test_a_line_counted_enough_is_not_written_again(spark):
    runs = m.Runs(spark, 3, fan=10)
    batch = lambda k: spark.createDataFrame([(b"hot", 10 * k + i) for i in range(4)] + [(b"own%d" % k, k)], "line binary, doc long")
    try:
        for k in reversed(range(4)):
            runs.add(batch(k))
        sizes = [spark.table(n).count() for n in runs.levels[0]]
        assert sizes == [2, 1, 1, 1]
        assert [tuple(r) for r in runs.shared().collect()] == [(bytearray(b"hot"), 33)]
    finally:
        runs.close()


def test_levels_are_merged_like_digits(spark):
    runs = m.Runs(spark, 3, fan=2)
    try:
        for k in range(5):
            runs.add(spark.createDataFrame([(b"a", k), (b"b%d" % k, k)], "line binary, doc long"))
        assert [len(level) for level in runs.levels] == [1, 0, 1]
        merged = runs.spark.table(runs.levels[2][0])
        assert {bytes(r["line"]): r["n"] for r in merged.collect()} == {b"a": 4, b"b0": 1, b"b1": 1, b"b2": 1, b"b3": 1}
    finally:
        runs.close()
