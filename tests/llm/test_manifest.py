from __future__ import annotations

import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from vigilark.llm import manifest as m
from vigilark.llm.registry import QUERIES, SQL

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, **other):
    values = [{**row, **other}[f] for f in FIELDS]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, index, node):
    """The siblings of a node up to the top, and the root after putting ``node`` in its place."""
    found = []
    for level in levels[:-1]:
        at = index - index % 2
        run = level[at : at + 2]
        found += [x for k, x in enumerate(run) if at + k != index]
        run[index - at] = node
        node, index = h(*run), index // 2
    return found, node


def plain(rows):
    """What the contract says, level by level in memory."""
    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row), row))
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        trees[g].sort(key=lambda t: t[:3])
    levels = {g: levels_of([t[2] for t in trees[g]]) for g in order}
    crown = levels_of([levels[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (_, _, leaf, row) in enumerate(trees[g]):
            changed = row["doc_id"] is not None and crc32(str(row["doc_id"]).encode()) % 7 == 0 and row["n_chars"] is not None
            start = leaf_of(row, n_chars=row["n_chars"] + 1) if changed else leaf
            below, node = climb(levels[g], i, start)
            above, root = climb(crown, k, node)
            whole = crown[-1][0]
            out.append((row["doc_id"], leaf, levels[g][-1][0], whole, h(*below, *above), root, root == whole))
    return sorted(out, key=str)


def found(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=str)


def run(df, bits):
    picked = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    return m.manifest(df, "doc_id", FIELDS, "lang", {"n_chars": F.when(picked, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, bits)


def test_append_log_has_the_nodes_where_the_closed_form_says():
    for n in [*range(1, 40), 64, 65, 100]:
        leaves = [h(str(i)) for i in range(n)]
        levels = levels_of(leaves)
        log = m.append_log(leaves, len(levels) - 1)
        assert len(log) == sum(map(len, levels))
        for level, nodes in enumerate(levels):
            for j, node in enumerate(nodes):
                assert log[m.place(level, j, n)] == node
        for i in range(n):
            assert m.fold(leaves[i], m.siblings(log, i, n, len(levels) - 1)) == levels[-1][0]


def test_the_query_equals_the_plain_version_and_sql(spark):
    assert difference(QUERIES["op12_merkle_manifest"](spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), SQL["op12_merkle_manifest"]) is None
    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = found(QUERIES["op12_merkle_manifest"](spark, "/root/testdata/sf0.01"))
    assert got == plain(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 4


@pytest.mark.parametrize("bits", [1, 3])
def test_many_layers_odd_rows_and_ties(spark, bits):
    rng = random.Random(bits)
    rows = [
        dict(doc_id=rng.choice([None, *range(30)]), text=rng.choice([None, "", "é x", "y" * 5000]), lang=rng.choice([None, "", "a", "é", "b"]), source=rng.choice([None, "s"]), n_chars=rng.choice([None, 0, 7]))
        for _ in range(60)
    ]
    rows += [dict(doc_id=k, text="t", lang=g, source="s", n_chars=1) for k, g in ((1, "lone"), (7, "pair"), (9, "pair"))] + rows[:5]
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SHAPE)
    clashing = df.withColumns({c: F.lit("x") for c in ("no", "n", "digest", "_group", "block", "path", "root", "key")})
    assert found(run(clashing, bits)) == plain(rows)


def test_no_rows_and_one_row(spark):
    none = spark.createDataFrame([], SHAPE)
    assert found(run(none, 2)) == []
    one = spark.createDataFrame([(None, None, None, None, None)], SHAPE)
    leaf = h("-----")
    assert found(run(one, 2)) == [(None, leaf, leaf, leaf, h(), leaf, True)]


def test_segments_make_up_the_whole_log(spark):
    rows = [("a" if i % 3 else "b", i, h(str(i))) for i in range(100)]
    leaves = spark.createDataFrame(rows, "g string, k long, d string").withColumn("digest", F.unhex("d"))
    layers = m.build(m.numbered(leaves, ["g"], ["k"]), ["g"], bits=2)
    for g in "ab":
        nodes = [r[2] for r in rows if r[0] == g]
        want = m.append_log(nodes, len(levels_of(nodes)) - 1)
        got = {}
        for r in m.log_segments(layers, ["g"], 2).where(F.col("g") == g).collect():
            for k in range(len(r["nodes"]) // 32):
                assert r["place"] + k not in got
                got[r["place"] + k] = r["nodes"][32 * k : 32 * k + 32].hex()
        assert [got[k] for k in range(len(got))] == want
