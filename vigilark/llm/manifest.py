"""A Merkle manifest of a table, kept as postorder append logs.

The leaves of a group ascend by key and are paired level by level; the last node of a level may stand alone.
A log holds the nodes in the order in which they are completed when leaves are appended one by one: after
leaf i all nodes whose last leaf it is. So a node's place follows from its level and its last leaf alone,
2 i - popcount(i) + level, and siblings are found in the log without any index.

A group is cut into aligned runs of ``2 ** bits`` leaves. A builder turns one run into its stretch of the log,
which is contiguous as the run is aligned; the tops of the runs are the leaves of the next layer. No task holds
more than a run, whatever the size of a group, and three layers of 1,024 reach 2 ** 30 leaves a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from vigilark.plans.keyed import join_null_safe
from vigilark.plans.rounds import sized

BITS = 10

SQL = r"""
    WITH RECURSIVE bits AS (
        SELECT b, list_reduce([b, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: xor(c // 2, (c % 2) * 3988292384)) AS v
        FROM (SELECT unnest(range(256)) AS b)
    ), crc AS (
        SELECT list(v ORDER BY b) AS t FROM bits
    ), rows AS (
        SELECT doc_id, lang, n_chars,
               coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
               || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS head,
               coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS tail,
               xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                               lambda c, x: xor(c // 256, list_extract(t, xor(c, x) % 256 + 1))), 4294967295) % 7 = 0 AS hit
        FROM documents, crc
    ), leaves AS (
        SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
               sha256(head || coalesce(strlen((n_chars + hit::INT)::VARCHAR)::VARCHAR || ':' || (n_chars + hit::INT)::VARCHAR, '-') || tail) AS other
        FROM (SELECT * REPLACE (coalesce(hit, FALSE) AS hit) FROM rows)
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
               count(*) OVER (PARTITION BY lang) AS n
        FROM leaves
    ), up(level, lang, i, h, n) AS (
        SELECT 0, lang, i, leaf, n FROM placed
        UNION ALL
        SELECT level + 1, lang, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY level, lang, i // 2, n
    ), crown AS (
        SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS m FROM up WHERE n = 1
    ), top(level, i, h, n) AS (
        SELECT 0, k, subroot, m FROM crown
        UNION ALL
        SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, i // 2, n
    ), paths AS (
        SELECT p.lang, p.i, u.level, list(s.h)[1] AS h, (p.i >> u.level) % 2 AS odd
        FROM placed p JOIN (SELECT DISTINCT lang, level FROM up WHERE n > 1) u ON p.lang IS NOT DISTINCT FROM u.lang
        LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = u.level AND s.i = xor(p.i >> u.level, 1)
        GROUP BY ALL
        UNION ALL
        SELECT p.lang, p.i, c.height + u.level, s.h, (c.k >> u.level) % 2
        FROM placed p JOIN crown c ON p.lang IS NOT DISTINCT FROM c.lang JOIN (SELECT DISTINCT level FROM top WHERE n > 1) u ON TRUE
        LEFT JOIN top s ON s.level = u.level AND s.i = xor(c.k >> u.level, 1)
    ), proofs AS (
        SELECT lang, i, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof, list({'h': coalesce(h, ''), 'odd': odd} ORDER BY level) AS steps
        FROM paths GROUP BY lang, i
    ), folded(lang, i, node, steps) AS (
        SELECT p.lang, p.i, p.other, coalesce(steps, []) FROM placed p LEFT JOIN proofs q ON p.lang IS NOT DISTINCT FROM q.lang AND p.i = q.i
        UNION ALL
        SELECT lang, i, sha256(CASE WHEN steps[1].odd = 1 THEN steps[1].h || node ELSE node || steps[1].h END), steps[2:] FROM folded WHERE len(steps) > 0
    )
    SELECT p.doc_id, p.leaf, c.subroot, t.h AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = t.h AS verified
    FROM placed p JOIN crown c ON p.lang IS NOT DISTINCT FROM c.lang JOIN (SELECT h FROM top WHERE n = 1) t ON TRUE
    LEFT JOIN proofs q ON p.lang IS NOT DISTINCT FROM q.lang AND p.i = q.i
    JOIN folded f ON p.lang IS NOT DISTINCT FROM f.lang AND p.i = f.i AND len(f.steps) = 0
"""


def digest(*hexes: str) -> str:
    return sha256("".join(hexes).encode()).hexdigest()


def place(level: int, index: int, leaves: int) -> int:
    """Where the log of a tree of ``leaves`` leaves has node ``index`` of ``level``."""
    last = min(leaves, (index + 1) << level) - 1
    return 2 * last - last.bit_count() + level


def append_log(leaves: Sequence[str], height: int) -> list[str]:
    """All nodes of a tree of ``height`` levels above its leaves, in the order of their completion."""
    log: list[str] = []
    waiting: list[str | None] = [None] * height
    for i, node in enumerate(leaves):
        log.append(node)
        for level in range(height):
            if waiting[level] is not None:
                node, waiting[level] = digest(waiting[level], node), None
            elif i == len(leaves) - 1:
                node = digest(node)
            else:
                waiting[level] = node
                break
            log.append(node)
    return log


def siblings(log: Sequence[str], index: int, leaves: int, height: int) -> list[str]:
    """A leaf's path: per level "<" or ">" (the sibling's side) and its digest, or "" where the node stands alone."""
    path = []
    for level in range(height):
        other = (index >> level) ^ 1
        if other << level >= leaves:
            path.append("")
        else:
            path.append(("<" if other & 1 == 0 else ">") + log[place(level, other, leaves)])
    return path


def fold(node: str, path: Sequence[str]) -> str:
    """The root that a leaf and a path give."""
    for step in path:
        if not step:
            node = digest(node)
        elif step[0] == "<":
            node = digest(step[1:], node)
        else:
            node = digest(node, step[1:])
    return node


def leaf_text(fields: Sequence[Column]) -> Column:
    """The fields one after another: "-" for null, else the number of UTF-8 bytes, ":", and the value."""
    shown = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown])


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``no``, the place from 0 within the group, and ``n``, the group's size.

    The rows are sorted by ranges of group and order together, so a large group is many ranges; the ranges'
    counts per group give each range what lies before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*groups, *order]
    at = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    rows = sized(at).withColumn("_part", F.shiftright("_at", 33))
    group = Window.partitionBy(*groups)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*groups, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    offsets = ranges.select(
        *groups, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"), F.sum("_n").over(group).alias("n")
    )
    found = join_null_safe(rows, sized(offsets), [*groups, "_part"])
    return found.withColumn("no", F.col("_at") + F.col("_offset")).drop("_at", "_part", "_offset")


def _builder(names: Sequence[str], bits: int, carried: Sequence[str], out: pa.Schema) -> Callable:
    """Turn one run of leaves into its stretch of the log, and keep the carried columns as lists beside it."""

    def run(key: tuple, leaves: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("no")
        height = min(bits, leaves.column("height")[0].as_py())
        log = append_log([d.hex() for d in leaves.column("digest").to_pylist()], height)
        row = {n: [v.as_py()] for n, v in zip(names, key)} | {
            "block": [key[-1].as_py()],
            "leaves": [leaves.num_rows],
            "levels": [height],
            "height": [leaves.column("height")[0].as_py() - height],
            "log": [bytes.fromhex("".join(log))],
            "top": [bytes.fromhex(log[-1])],
        }
        return pa.table(row | {c: [leaves.column(c).to_pylist()] for c in carried}, schema=out)

    return run


def build(leaves: DataFrame, groups: Sequence[str], carried: Sequence[str] = (), bits: int = BITS) -> list[DataFrame]:
    """The layers of logs of all groups, written; the last has one row per group, whose ``top`` is its root.

    ``leaves`` has the groups, ``no``, ``n``, ``digest`` (binary) and the carried columns. A row of a layer is a run:
    ``block``, ``leaves``, ``levels``, the ``log`` as 32 bytes a node.
    """
    height = F.when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    nodes = leaves.withColumn("height", height.cast("int"))
    layers: list[DataFrame] = []
    while True:
        lists = carried if not layers else ()
        ran = nodes.select(*groups, F.shiftright("no", bits).alias("block"), "no", "height", "digest", *lists)
        kinds = {f.name: f.dataType.simpleString() for f in ran.schema}
        ddl = [f"`{g}` {kinds[g]}" for g in groups] + ["block long", "leaves int", "levels int", "height int", "log binary", "top binary"]
        shape = StructType.fromDDL(", ".join(ddl + [f"`{c}` array<{kinds[c]}>" for c in lists]))
        build_run = _builder(groups, bits, lists, to_arrow_schema(shape))
        layers.append(sized(ran.groupBy(*groups, "block").applyInArrow(build_run, shape)))
        if layers[-1].where("height > 0").isEmpty():
            return layers
        nodes = layers[-1].select(*groups, F.col("block").alias("no"), "height", F.col("top").alias("digest"))


def log_segments(layers: Sequence[DataFrame], groups: Sequence[str], bits: int = BITS) -> DataFrame:
    """The log of every group as stretches: the ``place`` of the first node in the whole log, and the ``nodes``.

    A run of the first layer is one stretch; a node of an upper layer stands by itself.
    """
    first = F.shiftleft("block", bits)
    runs = layers[0].select(*groups, (2 * first - F.bit_count(first)).alias("place"), F.col("log").alias("nodes"))
    sizes = layers[0].groupBy(*groups).agg(F.sum("leaves").alias("_n"))
    for k, layer in enumerate(layers[1:], 1):
        upper = join_null_safe(layer.where("levels > 0"), sizes, groups)
        shape = runs.select(*groups, F.col("place").cast("long"), "nodes").schema

        def nodes(batches, k=k, names=shape.names, kinds=to_arrow_schema(shape)):
            for batch in batches:
                for row in batch.to_pylist():
                    for level in range(1, row["levels"] + 1):
                        found = []
                        for j in range((row["leaves"] + (1 << level) - 1) >> level):
                            at = 32 * place(level, j, row["leaves"])
                            whole = place(level + k * bits, (row["block"] << (bits - level)) + j, row["_n"])
                            found.append({**row, "place": whole, "nodes": row["log"][at : at + 32]})
                        yield pa.RecordBatch.from_pylist([{n: f[n] for n in names} for f in found], schema=kinds)

        runs = runs.unionByName(upper.mapInArrow(nodes, shape))
    return runs


def _paths_below(batches):
    """The path of every node of a run: its own siblings, then the path of the run's top."""
    for batch in batches:
        for row in batch.to_pylist():
            log = [row["log"][k : k + 32].hex() for k in range(0, len(row["log"]), 32)]
            m, levels = row["leaves"], row["levels"]
            rest = {k: row[k] for k in row if k not in ("block", "leaves", "levels", "log", "path")}
            made = [{**rest, "block": (row["block"] << row["bits"]) + i, "path": siblings(log, i, m, levels) + row["path"]} for i in range(m)]
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([(n, batch.schema.field(n).type) for n in made[0]]))


def paths_to(layers: Sequence[DataFrame], groups: Sequence[str], above: DataFrame, bits: int = BITS) -> DataFrame:
    """The path of the top of every run of the first layer: ``above`` (groups, ``path``, more columns) gives those of the roots."""
    paths = sized(above.withColumn("block", F.lit(0).cast("long")))
    more = [c for c in above.columns if c not in (*groups, "path")]
    for layer in reversed(layers[1:]):
        ran = join_null_safe(layer.select(*groups, "block", "leaves", "levels", "log"), paths, [*groups, "block"]).withColumn("bits", F.lit(bits))
        kinds = {f.name: f.dataType.simpleString() for f in ran.schema}
        names = [*groups, *more, "bits", "block", "path"]
        order = ran.select(*groups, *more, "bits", "block", "leaves", "levels", "log", "path")
        paths = sized(order.mapInArrow(_paths_below, ", ".join(f"`{c}` {kinds[c]}" for c in names)).drop("bits"))
    return paths


def _proofs(key_type: pa.DataType) -> Callable:
    """Every leaf of a run with its digest, its proof and the root that its folded path gives."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                log = [row["log"][k : k + 32].hex() for k in range(0, len(row["log"]), 32)]
                m, levels = row["leaves"], row["levels"]
                out: dict[str, list] = {n: [] for n in ("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
                for i in range(m):
                    path = siblings(log, i, m, levels) + row["path"]
                    leaf = log[place(0, i, m)]
                    changed = row["changed"][i]
                    root = fold(changed.hex() if changed is not None else leaf, path)
                    for n, v in zip(out, (row["key"][i], leaf, row["subroot"], row["root"], digest(*[p[1:] for p in path]), root, root == row["root"])):
                        out[n].append(v)
                kinds = [key_type, *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return run


def manifest(df: DataFrame, key: str, fields: Sequence[str], group: str, changed: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """One row per row of ``df``: its leaf, the root of its group, the root of all, and its proof checked.

    Leaves are digests of ``fields``; per ``group`` they ascend by ``key`` (nulls first, equal keys by their digest) and
    are paired up to the group's subroot, and the subroots, by group (null first, by bytes), up to the root. A single
    leaf or subroot is its own root. ``changed`` maps fields to other values: where one differs, the proof is folded from
    the leaf of the changed row, so ``verified`` tells whether the change is found.

    Nulls are values of their own in every column, repeated rows are leaves of their own, an empty table gives no
    row, and texts of any length are hashed where they are read. Columns other than the fields are not used, whatever
    their names. Text is read once; what is shuffled is the key and 32 bytes or 64 a row.
    """
    plain = F.sha2(leaf_text([F.col(f) for f in fields]), 256)
    other = [(changed or {}).get(f, F.col(f)) for f in fields]
    differs = reduce(lambda a, b: a | b, [~o.eqNullSafe(F.col(f)) for f, o in zip(fields, other) if f in (changed or {})], F.lit(False))
    leaves = sized(
        df.select(
            F.col(group).alias("_group"),
            F.col(key).alias("_key"),
            F.unhex(plain).alias("digest"),
            F.when(differs, F.unhex(F.sha2(leaf_text(other), 256))).alias("_changed"),
        )
    )
    layers = build(numbered(leaves, ["_group"], ["_key", "digest"]), ["_group"], ["_key", "_changed"], bits)
    subroots = layers[-1].select("_group", F.col("top").alias("digest"))
    crown = build(numbered(subroots, [], ["_group"]), [], ["_group"], bits)
    root = crown[-1].select(F.lower(F.hex("top")).alias("root"), F.array().cast("array<string>").alias("path"))
    tops = _subroot_paths(crown, root, bits)
    above = join_null_safe(tops, layers[-1].select("_group", F.lower(F.hex("top")).alias("subroot")), ["_group"])
    paths = paths_to(layers, ["_group"], above, bits)
    ran = join_null_safe(layers[0].select("_group", "block", "leaves", "levels", "log", "_key", "_changed"), paths, ["_group", "block"])
    whole = ran.select("leaves", "levels", "log", F.col("_key").alias("key"), F.col("_changed").alias("changed"), "subroot", "root", "path")
    kind = df.schema[key].dataType
    shape = f"key {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    proofs = whole.mapInArrow(_proofs(to_arrow_type(kind)), shape)
    return proofs.withColumnRenamed("key", key)


def _subroot_paths(crown: Sequence[DataFrame], root: DataFrame, bits: int) -> DataFrame:
    """(_group, root, path) of every subroot."""
    ran = join_null_safe(crown[0].select("block", "leaves", "levels", "log", "_group"), paths_to(crown, [], root, bits), ["block"])
    group = ran.schema["_group"].dataType.elementType
    kind = to_arrow_type(group)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                log = [row["log"][k : k + 32].hex() for k in range(0, len(row["log"]), 32)]
                paths = [siblings(log, i, row["leaves"], row["levels"]) + row["path"] for i in range(row["leaves"])]
                columns = [pa.array(row["_group"], kind), pa.array([row["root"]] * row["leaves"]), pa.array(paths, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["_group", "root", "path"])

    return ran.mapInArrow(run, f"_group {group.simpleString()}, root string, path array<string>")
