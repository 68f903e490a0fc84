from __future__ import annotations

import itertools
import random
import re

import pytest

from vigilark.llm.jaccard_join import jaccard_join, runs_for

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    pairs = {p for group in index.values() for p in itertools.combinations(group, 2)}
    for i, j in pairs:
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            r = find(i)
            least[r] = min(least.get(r, k), k)
    return sorted(((k, links[i], least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def got(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, class_id string, n_links int")
    return sorted((tuple(r) for r in jaccard_join(docs, **options).select("doc_id", "n_links", "class_id").collect()), key=str)


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


@pytest.mark.parametrize("limit", [2, 32])
def test_links_and_classes_are_those_of_brute_force(spark, limit):
    rng = random.Random(3)
    passage = words(rng, 50)
    rows = []
    for group in range(30):
        base = words(rng, rng.randrange(20, 120)) + (passage if group % 3 == 0 else [])
        for _ in range(rng.choice([1, 2, 3, 8])):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy)))
    hot = words(rng, 100)
    rows += [(1000 + i, " ".join(hot + [f"tail{i}"])) for i in range(90)] + [(2000 + i, " ".join(hot)) for i in range(20)]
    assert got(spark, rows, bucket_limit=limit, block_shingles=2000) == brute(rows)


def test_nulls_empty_short_and_repeated_rows(spark):
    rows = [(None, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one\ttwo"), (4, "one two"), (None, "one two"), (5, "x" * 300_000), (6, "x" * 300_000), (7, "é ü"), (8, "é")]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((tuple(r) for r in jaccard_join(docs).select("doc_id", "n_links", "class_id").collect()), key=str) == brute(rows)


def test_isolated_pairs_of_short_texts_are_all_found(spark):
    rng = random.Random(11)
    rows = []
    while len(rows) < 6000:
        base = words(rng, rng.randrange(10, 61))
        other = base[: len(base) - rng.randrange(0, 5)] + words(rng, rng.randrange(0, 8))
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    found = got(spark, rows)
    assert [r for r in found if r[1] == 0] == []
    assert found == brute(rows)


def test_runs_follow_the_recall_asked_for():
    assert [runs_for(r, 0.8) for r in (0.9, 0.99999, 0.999999)] == sorted(runs_for(r, 0.8) for r in (0.9, 0.99999, 0.999999))
    assert runs_for(0.99999, 0.8) == 5 and runs_for(0.9, 0.8) == 1
    with pytest.raises(ValueError):
        runs_for(0.9, 0.3)


def test_families_with_parts_of_their_own(spark):
    rng = random.Random(5)
    frame, long = words(rng, 9), words(rng, 60)
    misses = [(i, " ".join(frame + [f"end{i}"])) for i in range(2600)]  # 5 of 7 shingles: no links
    tails = [(10_000 + i, " ".join(long + [f"end{i}"])) for i in range(1300)]  # 56 of 58: all linked
    tails += [(20_000 + i, " ".join(long + [f"end{i}"])) for i in range(5)]  # copies
    bridge = [(30_000, " ".join(long[:50])), (30_001, " ".join(long[:50] + long[55:]))]
    rows = misses + tails + bridge
    assert got(spark, rows, block_sets=300) == brute(rows)


def test_blocks_are_bounded_by_sets(spark):
    rng = random.Random(6)
    base = words(rng, 40)
    rows = [(i, " ".join(base[: i % 30] + [f"v{i % 7}"] + base[i % 30 + 1 :])) for i in range(400)]
    rows += [(1000 + i, " ".join(base[: i % 30] + [f"u{i}"] + base[i % 30 + 1 :])) for i in range(200)]
    assert got(spark, rows, block_sets=25) == brute(rows)
