from __future__ import annotations

import inspect
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vigilark.llm import registry
from vigilark.llm.bytes_model import ppm_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def coded(text):
    return "".join(w + " " for w in tokens(text)).encode() + b"\0"


def brute(rows, order):
    counts = defaultdict(Counter)
    words = Counter()
    for _, text, held in rows:
        if not held:
            words.update([*tokens(text), None])
            data = b"\0" * order + coded(text)
            for i in range(order, len(data)):
                for k in range(order + 1):
                    counts[data[i - k : i]][data[i]] += 1
    total, types = sum(words.values()), len(words)

    def log(data, i):
        out, barred, entered = 0.0, set(), False
        for k in range(order, -1, -1):
            seen = counts.get(data[i - k : i])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in barred}
            entered = True
            if not left:
                continue
            n, d = sum(left.values()), len(left)
            if data[i] in left:
                return out + math.log10(left[data[i]] / (n + d))
            out += math.log10(d / (n + d))
            barred |= set(left)
        return out - math.log10(max(1, 256 - len(counts.get(b"", ()))))

    result = []
    for k, text, held in rows:
        data = b"\0" * order + coded(text)
        own = [*tokens(text), None]
        base = sum(math.log10((words[w] + 0.5) / (total + 0.5 * (types + 1))) for w in own)
        result.append((k, held, len(own), sum(words[w] > 0 for w in own), total, base, sum(log(data, i) for i in range(order, len(data)))))
    return sorted(result, key=str)


@pytest.mark.parametrize("frequent", [3, 100_000])
def test_scores_are_those_of_brute_force(spark, frequent):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 300).alias("text")).limit(40).collect()
    rows = [(r["doc_id"], r["text"], i % 3 == 0) for i, r in enumerate(given)]
    rows += [(None, "the The THE", True), (900, None, False), (901, "", True), (902, " \n", False), (903, "the é 日本 zzzz ~~~", True), (903, "the é 日本 zzzz ~~~", True), (904, "x" * 3000, True)]
    docs = spark.createDataFrame([(k, t, h, "s") for k, t, h in rows], "doc_id long, text string, h boolean, score string").repartition(3)
    got = sorted(map(tuple, ppm_scores(docs, F.col("h"), order=3, max_frequent=frequent).collect()), key=str)
    for a, b in zip(got, brute(rows, 3), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-6) and a[6] == pytest.approx(b[6], rel=1e-4)


def test_empty_and_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ppm_scores(empty, F.lit(False)).collect() == []
    one = ppm_scores(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), F.lit(True)).first()
    assert one["train_tokens"] == 0 and one["n_known"] == 0 and one["score"] == pytest.approx(-4 * math.log10(256))


def test_bounded_trie_and_folds(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = registry.QUERIES["op3_ppm_score"](spark, folder).collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in got)
    small = ppm_scores(docs, F.lit(False), max_grams=2000).agg(F.sum("score").alias("s")).first()["s"]
    plain = ppm_scores(docs, registry._fold("doc_id", 5) == 1, order=1).where("held_out").agg(F.sum("score").alias("s")).first()["s"]
    assert sum(r["score"] for r in got if r["held_out"]) > 0.9 * plain
    assert small < sum(r["score"] for r in got)


@pytest.mark.parametrize("cache", [0, 200])
def test_grams_that_are_not_cached_are_joined_exactly(spark, cache):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 300).alias("text")).limit(40).collect()
    rows = [(r["doc_id"], r["text"], i % 3 == 0) for i, r in enumerate(given)] + [(900, "the é 日本 zzzz ~~~", True), (901, "日本 語", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h boolean").repartition(3)
    got = sorted(map(tuple, ppm_scores(docs, F.col("h"), order=3, cache_grams=cache).collect()), key=str)
    for a, b in zip(got, brute(rows, 3), strict=True):
        assert a[:5] == b[:5] and a[6] == pytest.approx(b[6], rel=1e-9)


def test_no_gram_is_dropped_by_default():
    assert inspect.signature(ppm_scores).parameters["max_grams"].default is None
