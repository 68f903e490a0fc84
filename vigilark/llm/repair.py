"""Repair of conversations by the cheapest edits, ties by the least audit text.

The rows of a conversation are edited so that its roles read system (or not), then user and assistant in turn. The audit
is the text of the edits' initials. Two ways that reach one state after the same rows at the same cost are compared by
their audits. These are linked nodes that share prefixes: each node has its ancestors 1, 2, 4, ... back and a rolling hash
of its text, so the first difference of two audits is found in a logarithm of their length; a prefix taken for equal is
then walked and compared letter by letter.

A conversation is cut into chunks of its rows. For each pair of states a chunk gives its cheapest way from one to the
other, as a cost and the rank of its audit among the chunk's. All ways of a chunk take the same rows and end with one,
so none is the beginning of another and ranks decide as the texts would. Chunks are joined in the same manner, level by
level, so that no task holds more than a chunk of rows, or of chunks, of a long conversation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vigilark.llm.hashing import slices
from vigilark.plans.keyed import join_null_safe
from vigilark.plans.rounds import sized

# The states (nothing yet, after system, after user, after assistant), what may follow, and the costs.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
INSERTED = {START: ((START, 0), (USER, 1), (ASSISTANT, 2)), SYSTEM: ((SYSTEM, 0), (USER, 1), (ASSISTANT, 2)), USER: ((USER, 0), (ASSISTANT, 1)), ASSISTANT: ((ASSISTANT, 0), (USER, 1))}
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
RULE = {"keep": 0, "rerole": 3, "delete": 4, "insert": 3, "truncated": 3}
FULL = {"u": "user", "a": "assistant"}
SOUND = {"su", "ua", "au"}
SOUND_ROW, BLANK, DUPLICATE, TRUNCATED = range(4)
CODES = "abcdefghijklmnop"  # initial s, u, a or another, times four, plus the fault
ROWS, FAN = 1024, 256
_MODULUS = (1 << 61) - 1
_FACTOR = 1_000_003


class Audits:
    """Texts over small numbers as linked nodes; node 0 is the empty text."""

    def __init__(self):
        self.letter, self.depth, self.hash, self.back = [0], [0], [0], [[]]

    def add(self, parent: int, letter: int) -> int:
        node, back = len(self.letter), [parent]
        while len(self.back[back[-1]]) >= len(back):
            back.append(self.back[back[-1]][len(back) - 1])
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _FACTOR + letter + 1) % _MODULUS)
        self.back.append(back)
        return node

    def at_depth(self, node: int, depth: int) -> int:
        up = self.depth[node] - depth
        while up:
            node = self.back[node][up.bit_length() - 1]
            up -= 1 << (up.bit_length() - 1)
        return node

    def _fork(self, a: int, b: int) -> tuple[int, int]:
        """The nodes of equal depth just after the longest prefix of equal hash, or (a, a) if the hashes are equal."""
        if self.hash[a] == self.hash[b]:
            return a, b
        for k in range(len(self.back[a]) - 1, -1, -1):
            if k < len(self.back[a]) and self.hash[self.back[a][k]] != self.hash[self.back[b][k]]:
                a, b = self.back[a][k], self.back[b][k]
        return a, b

    def compare(self, a: int, b: int) -> int:
        """-1, 0 or 1 as the text of ``a`` is less than, equal to or greater than that of ``b``; a prefix is less."""
        least = min(self.depth[a], self.depth[b])
        x, y = self._fork(self.at_depth(a, least), self.at_depth(b, least))
        found = (self.letter[x] > self.letter[y]) - (self.letter[x] < self.letter[y]) if self.hash[x] != self.hash[y] else 0
        if self.hash[x] != self.hash[y]:
            x, y = self.back[x][0], self.back[y][0]
        while x != y:  # equal by hash: hold the letters against each other
            if self.letter[x] != self.letter[y]:
                found = 1 if self.letter[x] > self.letter[y] else -1
            x, y = self.back[x][0], self.back[y][0]
        return found or (self.depth[a] > self.depth[b]) - (self.depth[a] < self.depth[b])

    def text(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.back[node][0]
        return out[::-1]


Way = tuple[int, int]


def _better(audits: Audits, ways: dict[int, Way], state: int, cost: int, node: int, letters: Sequence[int]) -> None:
    """Keep the way to ``state`` if it is cheaper than the one known, or as cheap with a lesser audit."""
    known = ways.get(state)
    if known and known[0] < cost:
        return
    for letter in letters:
        node = audits.add(node, letter)
    if not known or cost < known[0] or audits.compare(node, known[1]) < 0:
        ways[state] = cost, node


D, I, K, R = b"DIKR"


def row_ways(codes: str, start: int, audits: Audits) -> dict[int, Way]:
    """The cheapest way from ``start`` to each state over rows given as ``CODES``."""
    ways: dict[int, Way] = {start: (0, 0)}
    for code in codes:
        initial, fault = divmod(CODES.index(code), 4)
        after: dict[int, Way] = {}
        late = RULE["truncated"] if fault == TRUNCATED else 0
        for state, (cost, node) in ways.items():
            for inner, n in INSERTED[state]:
                at, put = cost + n * RULE["insert"], [I] * n
                _better(audits, after, inner, at + RULE["delete"], node, [*put, D])
                if fault in (BLANK, DUPLICATE):
                    continue
                kept = KEPT.get("sua-"[initial], {}).get(inner)
                if kept is not None:
                    _better(audits, after, kept, at + RULE["keep"] + late, node, [*put, K])
                _better(audits, after, NEXT[inner], at + RULE["rerole"] + late, node, [*put, R])
        ways = after
    return ways


def chunk_ways(chunks: Sequence[dict[int, dict[int, Way]]], start: int, audits: Audits) -> dict[int, Way]:
    """The same over chunks, each given as start: end: (cost, rank); a letter holds the rank and the pair of states."""
    ways: dict[int, Way] = {start: (0, 0)}
    for chunk in chunks:
        after: dict[int, Way] = {}
        for state, (cost, node) in ways.items():
            for end, (more, rank) in chunk.get(state, {}).items():
                _better(audits, after, end, cost + more, node, [rank * 16 + state * 4 + end])
        ways = after
    return ways


def ranked(found: dict[int, dict[int, Way]], audits: Audits) -> dict[int, dict[int, Way]]:
    """Ways with the rank of the audit among all of them in place of the node."""
    order: list[list[int]] = []
    for node in (n for ends in found.values() for _, n in ends.values()):
        for at, same in enumerate(order):
            c = audits.compare(node, same[0])
            if c <= 0:
                if c:
                    order.insert(at, [node])
                else:
                    same.append(node)
                break
        else:
            order.append([node])
    rank = {n: k for k, same in enumerate(order) for n in same}
    return {s: {e: (c, rank[n]) for e, (c, n) in ends.items()} for s, ends in found.items()}


def closed(ways: dict[int, Way], audits: Audits | None = None) -> tuple[int, int]:
    """Cost and state of the cheapest way, with what must be inserted at the end; nodes are ranks if no audits are given."""
    best = None
    for state, (cost, node) in ways.items():
        cost += CLOSING[state] * RULE["insert"]
        if best is None or cost < best[0] or cost == best[0] and (audits.compare(node, best[2]) if audits else node - best[2]) < 0:
            best = cost, state, node
    return best[0], best[1]


def _matrix(ways: dict[int, dict[int, Way]]) -> list[dict]:
    return [{"s": s, "e": e, "cost": c, "rank": r} for s, ends in ways.items() for e, (c, r) in ends.items()]


def _from_matrix(rows: Sequence[dict]) -> dict[int, dict[int, Way]]:
    out: dict[int, dict[int, Way]] = {}
    for r in rows:
        out.setdefault(r["s"], {})[r["e"]] = r["cost"], r["rank"]
    return out


MATRIX = "array<struct<s:int,e:int,cost:bigint,rank:int>>"
_MATRIX = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())]))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrix of each chunk of rows; the first chunk of a conversation begins at the start only."""
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            audits = Audits()
            starts = [START] if row["first"] else [START, SYSTEM, USER, ASSISTANT]
            found.append(_matrix(ranked({s: row_ways(row["codes"], s, audits) for s in starts}, audits)))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(found, _MATRIX)], names=["conv", "chunk", "matrix"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrix of each run of chunks."""
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            audits, parts = Audits(), [_from_matrix(p["matrix"]) for p in row["parts"]]
            found.append(_matrix(ranked({s: chunk_ways(parts, s, audits) for s in parts[0]}, audits)))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(found, _MATRIX)], names=["conv", "chunk", "matrix"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a run with given ends, the states between its chunks."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            audits, parts = Audits(), [_from_matrix(p["matrix"]) for p in row["parts"]]
            node = chunk_ways(parts, row["s"], audits)[row["e"]][1]
            steps = [(x // 4 % 4, x % 4) for x in audits.text(node)]
            out.append([{"chunk": p["chunk"], "s": s, "e": e} for p, (s, e) in zip(row["parts"], steps)])
        kind = pa.list_(pa.struct([("chunk", pa.int64()), ("s", pa.int32()), ("e", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(out, kind)], names=["conv", "steps"])


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and end state of each conversation, from the one matrix it is left with."""
    for batch in batches:
        ends = [closed(_from_matrix(m)[START]) for m in batch.column("matrix").to_pylist()]
        columns = [pa.array([START] * len(ends), pa.int32()), pa.array([e for _, e in ends], pa.int32()), pa.array([c for c, _ in ends], pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), *columns], names=["conv", "chunk", "s", "e", "cost"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each chunk between its states, as text."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            audits = Audits()
            node = row_ways(row["codes"], row["s"], audits)[row["e"]][1]
            out.append(bytes(audits.text(node)).decode() + (("I" * CLOSING[row["e"]]) if row["final"] else ""))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("at"), batch.column("s"), batch.column("cost"), batch.column("codes"), pa.array(out, pa.string())], names=["conv", "at", "s", "cost", "codes", "edits"])


class _Conversation:
    """What is known of a conversation while its rows pass by in order; no row is kept."""

    def __init__(self, conv):
        self.conv, self.hash, self.audit = conv, sha256(), []
        self.turns = [None, None, 0]
        self.counts, self.illegal, self.cost, self.before, self.any = [0, 0, 0], 0, 0, None, False
        self.state, self.pending, self.codes = START, iter(()), iter(())

    def chunk(self, row: dict) -> None:
        self._rest()
        self.audit.append(row["edits"])
        self.cost = max(self.cost, row["cost"])
        self.pending, self.codes = iter(row["edits"]), iter(row["codes"])

    def _emit(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def _insert(self) -> None:
        self.state = NEXT[self.state]
        self._emit(FULL["u" if self.state == USER else "a"], "")

    def _rest(self) -> None:
        for letter in self.pending:
            assert letter == "I"
            self._insert()

    def row(self, row: dict) -> None:
        turn, role = row["turn"], row["role"]
        if turn is not None:
            low, last, n = self.turns
            self.turns = [turn if low is None else low, turn, n + (turn != last)]
        if self.before is not None and self.before + role[:1] not in SOUND:
            self.illegal += 1
        self.before = role[:1]
        fault = CODES.index(next(self.codes)) % 4
        if fault:
            self.counts[fault - 1] += 1
        letter = next(self.pending)
        while letter == "I":
            self._insert()
            letter = next(self.pending)
        if letter == "K":
            self.state = KEPT[role[:1]][self.state]
            self._emit(role, row["text"])
        elif letter == "R":
            self.state = NEXT[self.state]
            self._emit(FULL["u" if self.state == USER else "a"], row["text"])

    def result(self) -> tuple:
        self._rest()
        low, high, n = self.turns
        gaps = 0 if low is None else min(high - low + 1 - n, (1 << 63) - 1)
        return (self.conv, gaps, *self.counts, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _told(kind: pa.DataType):
    """One row per conversation from its rows in order, each chunk's edits before the chunk's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: _Conversation | None = None
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        for batch in slices(batches, "text", 1 << 20):
            done = []
            for row in batch.to_pylist():
                if open_ is None or row["conv"] != open_.conv:
                    done += [open_.result()] if open_ else []
                    open_ = _Conversation(row["conv"])
                if row["kind"] == 1:
                    open_.chunk(row)
                elif row["kind"] == 2:
                    open_.row(row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=["conv", *RESULT])
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(open_.result(), kinds)], names=["conv", *RESULT])

    return run


def damaged(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (conv, turn, role, text) after damage by crc32 of ``key:turn`` modulo 20; a null counts as one space.

    0 drops the row, 1 empties the text, 2 takes out its full stops, exclamation and question marks, 3 repeats the row,
    4 makes the role user. The null turn stays null for what follows.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(space(key), F.lit(":"), space(turn)), "UTF-8")) % 20
    rows = df.select(F.col(key).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), kind.alias("damage")).where("damage <> 0")
    said = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), copies.alias("copy"))


def _runs(level: DataFrame, fan: int) -> DataFrame:
    """Chunks gathered by ``fan`` neighbours of a conversation."""
    near = level.groupBy("conv", F.expr(f"chunk div {fan}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("chunk", "matrix"))).alias("parts"))
    return near.select("conv", F.col("run").alias("chunk"), "parts")


def repair(conversations: DataFrame, rows: DataFrame, size: int = ROWS, fan: int = FAN) -> DataFrame:
    """One row per ``conv`` of ``conversations``: the faults of its ``rows``, the cheapest edits and the repaired text's hash.

    ``rows`` has conv, turn, role and text, the last two not null. Rows go by turn (nulls first), equal turns by role and
    text; equal rows keep their number. A conversation without rows has zeros, an empty audit and the hash of no text.
    A null conv is a conversation like any other. ``turn`` must be a whole number; ``gaps`` ends at the largest long.

    The order is cut by ranges of (conv, turn, role, text), so a long conversation is in many tasks up to its last pass.
    Only that reads it in one task, row after row without keeping any, as SHA-256 has to: its memory does not grow.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["conv", "turn", "role", "text"]
    ordered = sized(
        rows.select(*by).repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    )
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    marks = ordered.select(
        "conv", "at", F.substring("role", 1, 1).alias("initial"), last.alias("last"), F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("said")
    )
    spoken = marks.where("last <> ''")
    repeats = sized(spoken.groupBy("conv", "said").agg(F.min("at").alias("at"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = join_null_safe(spoken.select("conv", "said", F.col("at").alias("_at")), repeats, ["conv", "said"]).where("_at > at").select("conv", F.col("_at").alias("at"))
    fault = F.when(F.col("last") == "", BLANK).when(F.col("repeated"), DUPLICATE).when(~F.col("last").isin(".", "!", "?"), TRUNCATED).otherwise(SOUND_ROW)
    told = marks.join(sized(later.select("at", F.lit(True).alias("repeated"))), "at", "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    code = F.struct("at", F.substring(F.lit(CODES), initial * 4 + fault + 1, F.lit(1)).alias("code"))
    stretch = F.shiftright("at", size.bit_length() - 1).alias("stretch")
    gathered = told.select("conv", stretch, code.alias("c")).groupBy("conv", "stretch").agg(F.array_sort(F.collect_list("c")).alias("c"))
    chunks = sized(gathered.select("conv", "stretch", F.get("c", F.lit(0))["at"].alias("at"), F.array_join(F.transform("c", lambda x: x["code"]), "").alias("codes")))
    w = Window.partitionBy("conv").orderBy("stretch")  # one narrow row per chunk
    numbers = chunks.select("conv", "stretch", (F.row_number().over(w) - 1).cast("long").alias("chunk"), F.lead("stretch").over(w).isNull().alias("final"))
    placed = sized(join_null_safe(chunks, numbers, ["conv", "stretch"]).withColumn("first", F.col("chunk") == 0).drop("stretch"))
    conv = rows.schema["conv"].dataType.simpleString()
    shape = f"conv {conv}, chunk long, matrix {MATRIX}"
    levels = [sized(placed.mapInArrow(_summed, shape))]
    while True:
        if levels[-1].groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
        levels.append(sized(_runs(levels[-1], fan).mapInArrow(_joined, shape)))
    ends = sized(levels[-1].mapInArrow(_last, f"conv {conv}, chunk long, s int, e int, cost long"))
    steps = ends
    for below in reversed(levels[:-1]):
        opened = join_null_safe(_runs(below, fan), steps, ["conv", "chunk"]).select("conv", "parts", "s", "e", "cost")
        cost = steps.groupBy("conv").agg(F.max("cost").alias("cost"))
        flat = opened.mapInArrow(_opened, f"conv {conv}, steps array<struct<chunk:bigint,s:int,e:int>>").select("conv", F.inline("steps"))
        steps = sized(join_null_safe(flat, cost, ["conv"]))
    edited = join_null_safe(placed, steps, ["conv", "chunk"]).select(
        "conv", "at", "s", "e", "cost", "final", "codes"
    )
    pieces = edited.mapInArrow(_edits, f"conv {conv}, at long, s int, cost long, codes string, edits string")
    every = conversations.select("conv").distinct().select("conv", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("kind"))
    stream = (
        every.unionByName(pieces.select("conv", "at", F.lit(1).alias("kind"), "cost", "codes", "edits"), allowMissingColumns=True)
        .unionByName(ordered.select("conv", "at", F.lit(2).alias("kind"), "turn", "role", "text"), allowMissingColumns=True)
    )
    in_order = stream.repartition(parts, "conv").sortWithinPartitions("conv", "at", "kind")
    return in_order.mapInArrow(_told(to_arrow_type(rows.schema["conv"].dataType)), f"conv {conv}, {', '.join(f'{c} long' for c in RESULT[:6])}, audit string, repaired_sha256 string")


def repaired_conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = ROWS, fan: int = FAN) -> DataFrame:
    """Damage a table of conversations, see ``damaged``, and repair it, see ``repair``; other columns are not read."""
    found = repair(df.select(F.col(key).alias("conv")), damaged(df, key, turn, role, text).drop("copy"), size, fan)
    return found.withColumnRenamed("conv", key)
