from __future__ import annotations

import random
import re
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from vigilark.llm import repair as m
from vigilark.llm.registry import QUERIES

SHAPE = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", *m.RESULT]
SPACE = " \t\n\x0b\x0c\r"


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.strip(SPACE)[-1:]
        out.append("b" if not end else "d" if (role, text) in seen else "t" if end not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(roles, found):
    """(cost, audit, choices) by comparing whole texts."""
    paths = {"": (0, "", [])}

    def insert(paths):
        for _ in range(3):
            for state, (cost, audit, made) in list(paths.items()):
                nxt = "a" if state == "u" else "u"
                way = (cost + 3, audit + "I", [*made, (nxt, None)])
                paths[nxt] = min(paths.get(nxt, way), way, key=lambda w: w[:2])
        return paths

    for i, (role, fault) in enumerate(zip(roles, found)):
        after = {}

        def offer(state, cost, letter, made):
            way = (cost, letter, made)
            after[state] = min(after.get(state, way), way, key=lambda w: w[:2])

        for state, (cost, audit, made) in insert(paths).items():
            offer(state, cost + 4, audit + "D", made)
            if fault in ("b", "d"):
                continue
            late = 3 if fault == "t" else 0
            nxt = "a" if state == "u" else "u"
            initial = role[:1]
            if initial == nxt or initial == "s" and state == "":
                offer(initial, cost + late, audit + "K", [*made, (None, i)])
            offer(nxt, cost + 3 + late, audit + "R", [*made, (nxt, i)])
        paths = after
    return min((w for s, w in insert(paths).items() if s in ("", "a")), key=lambda w: w[:2])


def plain(rows):
    groups = {r[0]: [] for r in rows}
    for conv, turn, role, text in hurt(rows):
        groups[conv].append((turn, role, text))
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        found = faults(own)
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, made = cheapest([r[1] for r in own], found)
        lines = [f"{({'u': 'user', 'a': 'assistant'}[n] if n else own[i][1])}:{'' if i is None else own[i][2]}" for n, i in made]
        out.append((conv, gaps, found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(NAMES).collect()), key=str)


def test_the_query_equals_the_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = found(QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.01"))
    assert got == plain(rows)
    assert any("I" in r[7] or "D" in r[7] or "R" in r[7] for r in got)


def made_up(rng, n, convs):
    texts = [None, "", " \t", "a", "a.", "Why?\n", "no!  ", "b .x", "x" * 3000 + ".", "é.", "."]
    return [(rng.choice(convs), rng.choice([None, *range(12)]), rng.choice([None, "", "system", "user", "assistant", "tool", "User", "usr", "é"]), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("size,fan", [(2, 2), (1024, 256)])
def test_odd_rows_equal_the_plain_version(spark, size, fan):
    rng = random.Random(size)
    rows = made_up(rng, 150, [None, 1, 2, 3, 4, *range(5, 40)])
    rows += [(77, k, "user" if k % 3 else "assistant", f"row {k}.") for k in range(40)]
    rows += [(78, 1, "user", "same.")] * 9 + [(79, None, None, None)] * 3
    df = spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit("x") for c in ("conv", "at", "kind", "chunk", "copy", "cost", "audit")})
    assert found(m.repaired_conversations(df, size=size, fan=fan)) == plain(rows)


def test_no_rows_and_nothing_left(spark):
    assert found(m.repaired_conversations(spark.createDataFrame([], SHAPE))) == []
    conv = next(k for k in range(1000) if crc32(f"{k}:1".encode()) % 20 == 0)
    got = found(m.repaired_conversations(spark.createDataFrame([(conv, 1, "user", "Hi.")], SHAPE)))
    assert got == [(conv, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]


def test_audits_compare_as_their_texts():
    rng = random.Random(1)
    audits, nodes = m.Audits(), [0]
    for _ in range(400):
        nodes.append(audits.add(rng.choice(nodes[-6:] + nodes[:3]), rng.choice(b"DI")))
    text = {n: bytes(audits.text(n)) for n in nodes}
    for _ in range(4000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert audits.compare(a, b) == (text[a] > text[b]) - (text[a] < text[b])


def test_equal_hashes_of_different_texts_do_not_decide(monkeypatch):
    monkeypatch.setattr(m, "_FACTOR", 1)  # the hash of a text is then its sum: DR = RD
    audits = m.Audits()
    a = audits.add(audits.add(0, ord("D")), ord("R"))
    b = audits.add(audits.add(0, ord("R")), ord("D"))
    assert audits.hash[a] == audits.hash[b] and audits.compare(a, b) == -1 and audits.compare(b, a) == 1
    c, d = audits.add(a, ord("R")), audits.add(b, ord("D"))
    assert audits.compare(c, d) == -1 and audits.compare(d, c) == 1
