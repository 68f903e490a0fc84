from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from vigilark.llm.tokens import END

FOLDER = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def prose(seed, n):
    rng = random.Random(seed)
    return "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(12)) + "." for _ in range(n))


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token rows"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), FOLDER).columns == docs.columns


def test_one_of_each_group_stays(spark):
    a, b = prose(1, 8), prose(2, 8)
    rows = [(3, a), (2, a), (2, a), (7, a + " more"), (5, b), (5, prose(3, 4)), (None, b + " x"), (9, None), (8, " ")]
    got = corpus_pipeline.near_duplicates(spark, docs_of(spark, [(k, t, "en", "s", 1) for k, t in rows]), FOLDER)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(2, a), (5, b), (5, prose(3, 4)), (9, None), (8, " ")], key=str)


def test_clean_documents_stay_and_passages_go(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    rows = [(i, prose(i, 10), "en", "s", 1) for i in range(20)] + [(50, prose(60, 5) + "\n" + item, "en", "s", 1), (51, "a | b | c | d", None, None, None), (52, None, None, None, None)]
    kept = corpus_pipeline.quality_rules(spark, docs_of(spark, rows), FOLDER)
    assert {r["doc_id"] for r in kept.collect()} == {*range(20), 50}
    assert {r["doc_id"] for r in corpus_pipeline.decontaminate(spark, kept, FOLDER).collect()} == set(range(20))


def test_mix_rows_hold_the_words_taken(spark):
    from vigilark.llm.apportion import mix

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = {r["doc_id"]: r["taken"] for r in mix(docs).where("taken > 0").collect()}
    got: dict = {}
    text = {r["doc_id"]: (r["text"] or "") for r in docs.collect()}
    for r in corpus_pipeline.mix_sources(spark, docs, FOLDER).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(corpus_pipeline._WORD.findall(r["text"]))
        assert all(part in text[r["doc_id"]] for part in r["text"].split("\n")) and r["n_chars"] == len(r["text"])
    assert got == want


def test_run_is_the_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
    plain = __import__("vigilark.llm.tokens", fromlist=["x"]).encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")[0]
    want = sorted((r["doc_id"], *plain.encode_ordinary(r["text"]), END) for r in docs.collect())
    pieces: dict = {}
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        ids = np.frombuffer(r["input_ids"], np.uint16)
        for d, k, n, a, b in zip(r["doc_ids"], r["pieces"], r["n_pieces"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            pieces.setdefault((d, n), {}).setdefault(k, []).append(ids[a:b].tolist())
    total = sum(len(p) for v in pieces.values() for ps in v.values() for p in ps)
    assert total == sum(len(w) - 1 for w in want)
    assert sorted(x for (d, n), v in pieces.items() if n == 1 for x in [(d, *p) for p in v[0]]) == [w for w in want if len(w) - 1 <= 2048]
