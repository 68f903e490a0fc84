from __future__ import annotations

import random

import numpy as np

from vigilark.llm import packing, separators
from vigilark.llm.tokens import END, VOCABULARY, encode, encoding

ODD = [None, "", " ", "a", " a b", "a  b", "a \n b", "x\n y z", "don't  stop's", "tail ", "é ü ß 　 x", "line\nline two\n\nthree", "1 22 333 !! ?? a1b2", "\x1c a \x85 b"]


def plain(text):
    return encoding(VOCABULARY)[0].encode_ordinary(text or "")


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, row int, shard string")


def given(spark):
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


def test_encoding_by_parts_is_plain_encoding(spark):
    texts = ODD + [t for _, t in given(spark)]
    ids, count = encode(texts)
    at = 0
    for text, n in zip(texts, count):
        assert ids[at : at + n].tolist() == plain(text), repr(text)[:80]
        at += n
    assert at == len(ids)


def test_best_fit_is_that_of_a_linear_search():
    rng = random.Random(2)
    for capacity in (1, 7, 64):
        lengths = np.array([rng.randrange(1, capacity + 1) for _ in range(200)])
        room, want = [], []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [(r, k) for k, r in enumerate(room) if r >= lengths[i]]
            least = min(fits)[0] if fits else None
            if least is None:
                room.append(capacity - lengths[i])
            else:
                room[next(k for r, k in fits if r == least)] -= lengths[i]
        got = packing.best_fit(lengths, capacity)
        assert sorted(i for row in got for i in row) == list(range(200))
        assert sorted(int(capacity - lengths[row].sum()) for row in got) == sorted(map(int, room))


def test_packing_is_lossless(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "none"), (3, "a"), (90, "word " * 5000)] + given(spark)[:60]
    got = packing.pack(docs_of(spark, rows).repartition(3), length=64, batch_tokens=4000).collect()
    docs = {}
    for r in got:
        ids, position = np.frombuffer(r["input_ids"], np.uint16), np.frombuffer(r["position_ids"], np.uint32)
        assert len(ids) == 64 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64
        assert (ids[r["n_tokens"] :] == END).all()
        for k, (a, b) in enumerate(zip(r["cu_seqlens"], r["cu_seqlens"][1:])):
            assert position[a:b].tolist() == list(range(b - a))
            docs.setdefault((r["doc_ids"][k], r["n_pieces"][k]), []).append((r["pieces"][k], ids[a:b].tolist()))
    want = {}
    for k, t in rows:
        own = plain(t) + [END]
        n = -(-len(own) // 64)
        want.setdefault((k, n), []).extend((i, own[64 * i : 64 * i + 64]) for i in range(n))
    assert {k: sorted(v) for k, v in docs.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(docs_of(spark, [])).collect() == []


def test_scan_stitches_blocks(spark):
    rng = random.Random(4)
    rows, want = [], []
    for file in range(3):
        ids = [7 if rng.random() < 0.03 else 1 for _ in range(1000)] if file else [1] * 300
        at, number, start, doc = 0, 0, 0, 0
        while at < len(ids):
            n = rng.choice([0, 1, 5, 40])
            rows.append((file, number, np.array(ids[at : at + n], "<u2").tobytes()))
            at, number = at + n, number + 1
        for i, x in enumerate(ids):
            if x == 7:
                want.append((file, doc, start, i - start, True))
                doc, start = doc + 1, i + 1
        if start < len(ids):
            want.append((file, doc, start, len(ids) - start, False))
    rows.append((9, 0, None))
    blocks = spark.createDataFrame(rows, "file int, number long, ids binary").repartition(5)
    assert sorted(map(tuple, separators.scan(blocks, end=7, group=4).collect())) == sorted(want)


def test_flat_files_and_counts(spark, tmp_path):
    np.array([1, 2, END, END, 3], "<u2").tofile(tmp_path / "a.bin")
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.col("path").alias("file"), F.lit(0).cast("long").alias("number"), F.col("content").alias("ids"))
    assert sorted(tuple(r)[1:] for r in separators.scan(files).collect()) == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, False)]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x y"), (3, "again")] + given(spark)
    got = separators.token_counts(docs_of(spark, rows).repartition(3)).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((k, len(plain(t))) for k, t in rows), key=str)
    assert separators.token_counts(docs_of(spark, [])).collect() == []
