from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from vigilark.functions.vectors import cosine
from vigilark.operators import texts, vectors


def test_dictionary_tags_match_whole_words_of_whole_texts(spark):
    long = "filler " * 50_000 + "Dürre"
    docs = spark.createDataFrame([(1, "Flood, flood; FLOODS!"), (2, long), (3, ""), (4, None)], "id int, text string")
    words = spark.createDataFrame([("flood", "water", 1.5), ("dürre", "water", 2.0), ("flood", "risk", 1.0)], "term string, tag string, weight double")
    got = texts.dictionary_tags(docs, "id", "text", words)
    assert "broadcast" not in got._jdf.queryExecution().analyzed().toString()
    assert rows(got, "id", "tag", "n_hits", "score") == [
        (1, "risk", 2, 2.0), (1, "water", 2, 3.0), (2, "water", 1, 2.0)
    ]


def test_tf_idf(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "a c"), (3, "a")], "id int, text string")
    got = texts.tf_idf_terms(docs, "id", "text", 1)
    assert rows(got, "id", "term", "tf_idf") == [
        (1, "b", pytest.approx(2 * math.log(4 / 2))), (2, "c", pytest.approx(math.log(4 / 3))), (3, "a", 0.0)
    ]


@pytest.mark.parametrize("common", [3, 50_000])
def test_tf_idf_of_repeated_keys_and_of_rare_terms(spark, common):
    data = [(i, " ".join(f"{c}x" for c in "abcdefghijkl"[: 2 + i % 9]) + " ax" * (i % 4)) for i in range(30)]
    data += [(3, "zx zx, ax"), (None, "ax bx"), (None, "BX;qx"), (40, ""), (41, None), (42, "?!")]
    texts_of, df = {}, {}
    for i, t in data:
        texts_of.setdefault(i, []).extend(re.findall("[a-z]+", (t or "").lower()))
    for ws in texts_of.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    want = []
    for i, ws in texts_of.items():
        best = sorted((-round(ws.count(w) * math.log((len(data) + 1) / (df[w] + 1)), 9), w) for w in set(ws))[:3]
        want += [(i, p + 1, w, ws.count(w)) for p, (_, w) in enumerate(best)]
    got = texts.tf_idf_terms(spark.createDataFrame(data, "id int, text string"), "id", "text", 3, common)
    assert rows(got, "id", "position", "term", "n") == sorted(want, key=lambda r: [(v is not None, v) for v in r])


def test_tf_idf_counts_words_where_the_text_lies(spark, monkeypatch):
    """Counting over a shuffle, and joining every count by its term, moved the counts three times."""
    counted, count = [], texts.term_counts
    monkeypatch.setattr(texts, "term_counts", lambda df, *a: counted.append(df.count()) or count(df, *a))
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (2, "a"), (3, "b")], "id int, text string")
    plan = texts.tf_idf_terms(docs, "id", "text", 1)._jdf.queryExecution().optimizedPlan().toString()
    assert counted == [2] and "strategy=broadcast" in plan


def test_hosts_of_odd_addresses(spark):
    urls = ["http://a.org/x/y?q=1#f", "http://a.org", "not an address", None]
    got = texts.host_profile(spark.createDataFrame([(u,) for u in urls], "url string"), "url")
    assert rows(got, "host", "n_urls", "n_with_query", "n_with_fragment", "max_depth")[1:] == [("a.org", 2, 1, 1, 2)]


def test_vectors(spark):
    data = [(1, "g", [1.0, 0.0]), (2, "g", [0.0, 1.0]), (3, "g", [2.0, 2.0]), (4, "z", [0.0, 0.0])]
    df = spark.createDataFrame(data, "id int, g string, v array<float>")
    assert rows(df.select("id", cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")))[3] == (4, None)
    assert rows(vectors.group_centroids(df, ["g"], "v", 2), "g", "n_members", "centroid") == [("g", 3, [1.0, 1.0]), ("z", 1, [0.0, 0.0])]
    assert rows(vectors.central_members(df, "id", ["g"], "v", 2, 2).where("g = 'g'"), "position", "id") == [(1, 3), (2, 1)]
    assert rows(vectors.centroid_outliers(df, "id", ["g"], "v", 2, 0.2), "id") == [(1,), (2,)]


def test_a_vector_of_another_length_is_an_error(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0, 3.0]), (2, "a", [1.0, 2.0, 4.0])], "id int, g string, v array<float>")
    assert vectors.similarity_to_centroid(df, "id", ["g"], "v", 3).count() == 2
    with pytest.raises(Exception, match="has 3 values, not 2"):
        vectors.group_centroids(df, ["g"], "v", 2).collect()
