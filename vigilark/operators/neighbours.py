"""Nearest vectors by cosine: exact by pivots, and approximate by the signs of random projections.

Both work on distinct vectors: rows with the very same vector are one class, known by its least key, and only the
``k`` least keys of a class are ever needed. So a vector that a third of the rows share is compared once.

Null vectors and vectors without a finite length are nobody's neighbour and have none; a vector of another length is an error.

Blocks of queries and of vectors are dealt out by Spark and compared in tasks as one product of matrices each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from vigilark.functions.vectors import dot
from vigilark.operators.entities import top_k_per_group
from vigilark.operators.vectors import _of_length
from vigilark.plans.rounds import sized

SLACK = 1e-6
TILE = 1 << 21  # similarities held at once by a task: 16 MB
# In comparisons of a block: about what a key of a vector costs, which is written, shuffled and joined, and a pair that a bucket gives.
KEY, PAIR = 200, 500


def _distance(similarity: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * similarity))


def classes(df: DataFrame, key: str, vector: str, length: int, asks: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """(distinct vectors: ``id``, ``unit``, ``asks``; members: ``id``, ``member``, ``rank`` and ``asks``), both written.

    ``asks`` marks the rows that are queries. Of a class the ``k`` + 1 least members are kept, and all that ask.
    """
    rows = df.select(F.col(key).alias("member"), _of_length(vector, length).alias("v"), asks.alias("asks"))
    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    rows = rows.where(F.col("v").isNotNull()).withColumn("norm", norm).where("norm > 0 AND norm < double('Infinity')")
    found = rows.groupBy("v").agg(F.min("member").alias("id"), F.first("norm").alias("norm"), F.max("asks").alias("asks"), F.count("*").alias("n"))
    distinct = sized(found)
    unit = F.transform("v", lambda x: x.cast("double") / F.col("norm"))
    shared = distinct.where("n > 1").select("v", "id")
    copies = rows.join(shared, "v").select("id", "member", "asks")
    least = top_k_per_group(copies.select("id", "member", "asks"), ["id"], [F.col("member")], k + 1).select("id", "member", "asks", F.col("position").alias("rank"))
    # A copy that asks but is not among the least has rank null: it asks, and is in no answer.
    others = copies.where("asks").join(least.select("id", "member"), ["id", "member"], "left_anti").select("id", "member", "asks", F.lit(None).cast("long").alias("rank"))
    single = distinct.where("n = 1").select("id", F.col("id").alias("member"), "asks", F.lit(1).cast("long").alias("rank"))
    members = sized(single.unionByName(least).unionByName(others))
    return sized(distinct.select("id", unit.alias("unit"), "asks")), members


def _answers(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """``found`` (query, id, similarity: the ``k`` + 1 nearest classes) as the ``k`` nearest rows of every row that asks."""
    near = found.join(members.where("rank is not null").select("id", F.col("member").alias("neighbour"), "rank"), "id")
    best = top_k_per_group(near.select("query", "neighbour", "similarity"), ["query"], [F.col("similarity").desc(), F.col("neighbour")], k + 1).drop("position")
    asking = members.where("asks").select(F.col("id").alias("query"), F.col("member").alias("asker"))
    rows = best.join(asking, "query").where("neighbour <> asker").select("asker", "neighbour", "similarity")
    return top_k_per_group(rows, ["asker"], [F.col("similarity").desc(), F.col("neighbour")], k)


def _matrix(vectors: pa.ChunkedArray, length: int) -> np.ndarray:
    return pc.list_flatten(vectors).to_numpy().reshape(-1, length)


def _least_kept(s: np.ndarray, floor: np.ndarray, k: int) -> np.ndarray:
    """``floor`` per row of ``s``, raised to the ``k``-th greatest value, less a little for ties, where more than ``k`` values reach it."""
    many = np.flatnonzero(np.count_nonzero(s >= floor[:, None], axis=1) > k)
    raised = floor.copy()
    if len(many):
        raised[many] = np.maximum(floor[many], np.partition(s[many], -k, axis=1)[:, -k] - 1e-8)
    return raised


def closest(asking: DataFrame, rows: DataFrame, on: Sequence[str], length: int, k: int) -> DataFrame:
    """(``query``, ``id``, ``similarity`` rounded to 9 places): in each block ``on`` the ``k`` rows most similar to each query; ties go to the lesser id.

    ``asking`` holds ``query``, its unit vector ``q`` and ``floor``, below which a similarity is left out; ``rows`` hold ``id`` and ``unit``.
    One task holds the queries and the rows of one block, so both must be dealt to blocks of bounded size.
    """
    out = StructType([StructField("query", asking.schema["query"].dataType), StructField("id", rows.schema["id"].dataType), StructField("similarity", DoubleType())])

    def compared(queries: pa.Table, block: pa.Table) -> pa.Table:
        q, v, floor = _matrix(queries["q"], length), _matrix(block["unit"], length), queries["floor"].to_numpy()
        step, found = max(1, TILE // max(1, len(v))), []
        for at in range(0, len(q) if len(v) else 0, step):
            s = q[at : at + step] @ v.T
            row, column = np.nonzero(s >= _least_kept(s, floor[at : at + step], k)[:, None])
            part = pa.table({"row": row, "similarity": np.round(s[row, column], 9), "id": block["id"].take(pa.array(column))})
            if len(row) and np.bincount(row).max() > k:
                part = part.sort_by([("row", "ascending"), ("similarity", "descending"), ("id", "ascending")])
                row = part["row"].to_numpy()
                part = part.filter(pa.array(np.arange(len(row)) - np.searchsorted(row, row) < k))
            found.append(pa.table({"query": queries["query"].take(pc.add(part["row"], at)), "id": part["id"], "similarity": part["similarity"]}))
        return pa.concat_tables(found) if found else pa.table({"query": queries["query"][:0], "id": block["id"][:0], "similarity": pa.array([], "double")})

    sides = asking.select(*on, "query", "q", "floor").groupBy(*on), rows.select(*on, "id", "unit").groupBy(*on)
    return sides[0].cogroup(sides[1]).applyInArrow(compared, out)


def with_distances(distinct: DataFrame, centres: np.ndarray) -> DataFrame:
    """``distinct`` with ``far``, the distance to each of ``centres``."""
    length = centres.shape[1]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = pc.list_flatten(batch["unit"]).to_numpy().reshape(-1, length) @ centres.T
            far = pa.array(np.sqrt(np.maximum(0.0, 2 - 2 * s)).ravel())
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(centres))
            yield batch.append_column("far", pa.ListArray.from_arrays(ends, far))

    return distinct.mapInArrow(measured, StructType([*distinct.schema.fields, StructField("far", ArrayType(DoubleType()))]))


def _chunks_of_queries(asking: DataFrame, rows: DataFrame, asked: int, part: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``chunk``: the queries dealt to chunks of about ``part``, and every row once per chunk."""
    n = max(1, math.ceil(asked / part))
    chunk = F.pmod(F.xxhash64("query", F.lit(3)), F.lit(n))
    return asking.withColumn("chunk", chunk), rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


class Blocks:
    """Distinct vectors in blocks: the nearest of some pivots, and a ring of distances around it.

    The pivots are the ``pivots`` vectors of least hash, a bounded sample; every vector is in a block. There are at most
    pivots x rings blocks, whatever the data; the pivots and the blocks' counts and ranges go to all tasks. Large blocks
    are dealt to parts of about ``part`` vectors by a hash.
    """

    def __init__(self, distinct: DataFrame, length: int, pivots: int = 32, rings: int = 16, part: int = 16384):
        self.length = length
        centres = [r["unit"] for r in distinct.orderBy(F.xxhash64("unit"), "id").limit(pivots).collect()]
        d = F.array_min("far")
        placed = with_distances(distinct, np.array(sorted(centres)).reshape(-1, length)).withColumns({"pivot": (F.array_position("far", d) - 1).cast("int"), "d": d, "ring": F.floor(d * rings / 2).cast("int")})
        placed = sized(placed.withColumn("mix", F.xxhash64("unit", F.lit(1))))
        self.stats = sized(
            placed.groupBy("pivot", "ring")
            .agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
            .withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
        )
        self.all = self.stats.agg(F.collect_list(F.struct("pivot", "ring", "n", "low", "high", "parts")).alias("b"))
        parts = self.stats.select("pivot", "ring", "parts", "n")
        self.rows = placed.join(parts, ["pivot", "ring"]).withColumn("part", F.pmod("mix", "parts"))

    def first_bound(self, k: int) -> DataFrame:
        """Each asking vector with ``tau``, a distance within which its ``k`` nearest lie.

        That of the k-th in its own part, or, where its block holds fewer, in the first part of the block that lies nearest as a whole.
        """
        asks = self.rows.where("asks").select(F.col("id").alias("query"), F.col("unit").alias("q"), "far", "n", "pivot", "ring", "part").withColumn("_all", sized(self.all).scalar())
        upper = lambda b: F.get("far", b["pivot"]) + b["high"]
        whole = F.filter("_all", lambda b: b["n"] >= k)
        home = F.array_min(F.transform(whole, lambda b: F.struct(upper(b).alias("u"), b["pivot"].alias("pivot"), b["ring"].alias("ring"))))
        seen = asks.withColumn("_home", home).drop("_all")
        at = lambda name, other: F.when(F.col("n") >= k, F.col(name)).otherwise(other).alias(name)
        at_home = sized(
            seen.select(
                "query", "q", "far", F.coalesce(F.col("_home.u"), F.lit(2.0)).alias("u"),
                at("pivot", F.col("_home.pivot")), at("ring", F.col("_home.ring")), at("part", F.lit(0)), F.lit(-2.0).alias("floor"),
            )
        )
        near = closest(at_home.where("pivot IS NOT NULL"), self.rows, ["pivot", "ring", "part"], self.length, k)
        kth = near.groupBy("query").agg(F.count("*").alias("m"), F.min("similarity").alias("s")).where(F.col("m") >= k)
        kth = sized(kth.select("query", _distance(F.col("s")).alias("kth")))
        return sized(at_home.join(kth, "query", "left").select("query", "q", "far", F.least("u", F.coalesce("kth", F.lit(2.0))).alias("tau")))

    def visits(self, bounded: DataFrame) -> DataFrame:
        """The blocks that can hold a vector within ``tau``, by the triangle inequality; one row per query and part."""
        seen = bounded.withColumn("_all", sized(self.all).scalar())
        away = lambda b: F.get("far", b["pivot"])
        may = F.filter("_all", lambda b: (away(b) - b["high"] <= F.col("tau") + SLACK) & (b["low"] - away(b) <= F.col("tau") + SLACK))
        blocks = seen.select("query", "q", "tau", F.inline(may))
        return blocks.select("query", "q", "tau", "pivot", "ring", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))


def nearest(
    df: DataFrame, key: str, vector: str, length: int, asks: Column, k: int, pivots: int = 32, rings: int = 16, part: int = 16384
) -> DataFrame:
    """The ``k`` rows most similar to each row for which ``asks`` holds, without itself: exact.

    (key, ``neighbour``, ``similarity`` rounded to 9 places, ``position``); ties go to the lesser key. Only blocks that the
    triangle inequality does not rule out are visited; with vectors that have no structure these are all of them, and the
    work is queries times vectors, in parts of bounded size. Keys must be unique and not null.
    """
    distinct, members = classes(df, key, vector, length, asks, k)
    blocks = Blocks(distinct, length, pivots, rings, part)
    bounded = blocks.first_bound(k + 1)
    floor = 1 - (F.col("tau") + SLACK) * (F.col("tau") + SLACK) / 2
    asking, rows = _chunks_of_queries(blocks.visits(bounded).withColumn("floor", floor), blocks.rows, bounded.count(), part)
    found = closest(asking, rows, ["pivot", "ring", "part", "chunk"], length, k + 1)
    best = top_k_per_group(found, ["query"], [F.col("similarity").desc(), F.col("id")], k + 1).drop("position")
    return _answers(sized(best), members, k).withColumnRenamed("asker", key)


def _agree(least: float) -> float:
    """The chance that a random hyperplane leaves two vectors of this cosine on one side."""
    return 1 - math.acos(least) / math.pi


def key_plan(least: float, recall: float, n: int) -> tuple[int, int]:
    """(bits of a half key, number of half keys) of least work for ``n`` vectors.

    A table's key is a pair of half keys, so two vectors meet if at least two of the halves agree.
    """
    best: tuple[float, int, int] | None = None
    for bits in range(1, 13):
        same = _agree(least) ** bits
        for halves in range(2, 41):
            met = 1 - (1 - same) ** halves - halves * same * (1 - same) ** (halves - 1)
            if met >= recall:
                work = halves * (halves - 1) / 2 * (20 + n / 4**bits)  # a key costs as much as some comparisons
                if best is None or work < best[0]:
                    best = work, bits, halves
                break
    return best[1], best[2]


def keys_pay(n: int, asked: int, least: float, recall: float) -> bool:
    """Whether the buckets of ``key_plan`` are less work than comparing ``asked`` queries with all ``n`` vectors in blocks.

    With a small ``least`` the keys are so many that each pair meets in several of them; then they never are.
    """
    bits, halves = key_plan(least, recall, max(1, n))
    return halves * (halves - 1) / 2 * (KEY + PAIR * asked / 4**bits) < asked


def sign_keys(unit: Column, length: int, bits: int, halves: int, seed: int) -> Column:
    """Half keys: which side of ``bits`` random hyperplanes each the vector lies on."""
    planes = np.random.default_rng(seed).standard_normal((halves, bits, length)).round(4)
    of = lambda inner: f"array({','.join(inner)})"
    constant = of(of(of(f"{x}D" for x in plane) for plane in half) for half in planes.tolist())
    side = lambda bit, plane: bit * 2 + F.when(dot(unit, plane) > 0, 1).otherwise(0)
    return F.transform(F.expr(constant), lambda half: F.aggregate(half, F.lit(0), side))


def fine_plan(least: float, recall: float, tables: int = 4) -> tuple[int, int]:
    """(bits, number) of the further keys that part a hot bucket: as many bits as about ``tables`` keys can afford."""
    enough = 1 - (1 - recall) ** (1 / tables)
    bits = max(1, int(math.log(enough) / math.log(_agree(least)))) if least < 1 else 12
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(_agree(least) ** bits, 1 - 1e-9))))


def sign_buckets(distinct: DataFrame, length: int, least: float, recall: float, limit: int) -> DataFrame:
    """(bucket, id, n) of every vector under every pair of half keys; a bucket of over ``limit`` is parted by further bits.

    The further bits are of planes of their own, in a few tables, so a vector of a hot bucket is in a few buckets in its place.
    Both steps reach the root of ``recall``. What is then still over ``limit`` are vectors too alike to be parted.
    """
    step = math.sqrt(recall)
    bits, halves = key_plan(least, step, max(1, distinct.count()))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(halves) for b in range(a)])
    keyed = distinct.select("id", sign_keys(F.col("unit"), length, bits, halves, 7).alias("_h")).select("id", "_h", F.explode(pairs).alias("_p"))
    found = sized(keyed.select("id", F.xxhash64("_p.a", "_p.b", F.get("_h", F.col("_p.a")), F.get("_h", F.col("_p.b"))).alias("bucket")))
    sizes = sized(found.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    bits, tables = fine_plan(least, step)
    hot = found.join(sizes.where(F.col("n") > limit).select("bucket"), "bucket")
    parted = hot.join(distinct.select("id", sign_keys(F.col("unit"), length, bits, tables, 8).alias("_h")), "id")
    again = sized(parted.select("id", "bucket", F.posexplode("_h")).select("id", F.xxhash64("bucket", "pos", "col").alias("bucket")))
    finer = again.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    columns = ["bucket", "id", "n"]
    return found.join(sizes.where(F.col("n") <= limit), "bucket").select(*columns).unionByName(again.join(finer, "bucket").select(*columns))


def _by_signs(distinct: DataFrame, length: int, least: float, recall: float, limit: int) -> DataFrame:
    """(``query``, ``id``, ``similarity``) of the pairs of ``least`` or more that meet in a bucket, once each."""
    buckets = sized(sign_buckets(distinct, length, least, recall, limit).withColumn("parts", F.ceil(F.col("n") / limit).cast("int")))
    rows = buckets.join(distinct.select("id", "unit", "asks"), "id")
    asking = rows.where("asks").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), F.col("id").alias("query"), F.col("unit").alias("q"))
    dealt = rows.select("bucket", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id", "unit")
    pairs = asking.join(dealt, ["bucket", "part"]).select("query", "id", F.round(dot(F.col("q"), F.col("unit")), 9).alias("similarity"))
    return pairs.where(F.col("similarity") >= least).groupBy("query", "id").agg(F.first("similarity").alias("similarity"))


def _by_blocks(distinct: DataFrame, length: int, n: int, asked: int, least: float, k: int, part: int = 16384) -> DataFrame:
    """The ``k`` best pairs of ``least`` or more of each query and part, from all vectors."""
    parts = max(1, math.ceil(n / part))
    whole = distinct.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    asking = distinct.where("asks").select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.col("id").alias("query"), F.col("unit").alias("q"), F.lit(least - 1e-8).alias("floor")
    )
    found = closest(*_chunks_of_queries(asking, whole, asked, part), ["part", "chunk"], length, k)
    return found.where(F.col("similarity") >= least)


def similar(
    df: DataFrame, key: str, vector: str, length: int, asks: Column, k: int, least: float, recall: float = 0.95, limit: int = 4096, by_signs: bool | None = None
) -> DataFrame:
    """Up to ``k`` rows of similarity ``least`` or more for each row for which ``asks`` holds, without itself.

    Each such pair is found with a chance of about ``recall`` or more; what is found is compared exactly. Columns as in ``nearest``.
    Sign keys are used where they are less work than comparing the queries with all vectors, which finds every pair; ``by_signs`` overrides
    this. Buckets are dealt to parts of ``limit`` by a hash, so that no task holds a large one, and a pair met in several tables is compared in each.
    """
    distinct, members = classes(df, key, vector, length, asks, k)
    n, asked = distinct.agg(F.count("*"), F.count_if("asks")).first()
    if by_signs is None:
        by_signs = keys_pay(n, asked, least, math.sqrt(recall))
    found = _by_signs(distinct, length, least, recall, limit) if by_signs else _by_blocks(distinct, length, n, asked, least, k + 1)
    own = distinct.where("asks").select(F.col("id").alias("query"), "id", F.lit(1.0).alias("similarity"))
    best = top_k_per_group(found.where("query <> id").unionByName(own), ["query"], [F.col("similarity").desc(), F.col("id")], k + 1).drop("position")
    return _answers(sized(best), members, k).withColumnRenamed("asker", key)
