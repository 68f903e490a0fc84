"""Documents in flat token files without an index, found by their end-of-document ids."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilark.llm.hashing import slices
from vigilark.llm.tokens import END, VOCABULARY, encode
from vigilark.plans.rounds import shared_folder

BLOCK = 1 << 16


def _stream(path: str, end: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, first = TaskContext.get().partitionId(), 0, 0
        rest = np.zeros(0, np.uint16)

        def rows(ids: list[bytes], keys: list | None) -> pa.RecordBatch:
            n = len(ids) if keys is None else 1
            start = number if keys is None else first
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(["tokens" if keys is None else "names"] * n),
                    pa.array([file] * n, pa.int32()),
                    pa.array(range(start, start + n), pa.int64()),
                    pa.array(ids if keys is None else [None], pa.binary()),
                    pa.array([None] * n if keys is None else [keys], pa.list_(pa.int64())),
                ],
                names=["kind", "file", "number", "ids", "keys"],
            )

        for part in slices(batches, "text", 1 << 20):
            ids, count = encode(part.column("text").to_pylist(), path)
            flat = np.concatenate([rest, np.insert(ids, np.cumsum(count), end)])
            whole = len(flat) // block * block
            if whole:
                blocks = rows([flat[i : i + block].tobytes() for i in range(0, whole, block)], None)
                yield blocks
                number += blocks.num_rows
            rest = flat[whole:]
            yield rows([], part.column("doc").to_pylist())
            first += part.num_rows
        if len(rest):
            yield rows([rest.tobytes()], None)

    return run


def write_stream(docs: DataFrame, key: str = "doc_id", text: str = "text", end: int = END, vocabulary: str = VOCABULARY, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Token files in the shared folder: (blocks, names).

    ``blocks`` (file, number, ids): each input split's documents as one run of ids with ``end`` after
    every document, cut into blocks of ``block`` ids wherever they fall. ``names`` (file, number, keys):
    the keys in their order, ``number`` being the place of the first. The blocks hold no bounds.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    schema = "kind string, file int, number long, ids binary, keys array<long>"
    out = rows.mapInArrow(_stream(vocabulary, end, block), schema)
    out.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(schema).parquet(path)
    return back.where("kind = 'tokens'").select("file", "number", "ids"), back.where("kind = 'names'").select("file", "number", "keys")


def _scanned(end: int, width: int):
    kind = {2: np.dtype("<u2"), 4: np.dtype("<u4")}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for raw in batch.column("ids").to_pylist():
                ids = np.frombuffer(raw or b"", kind)
                sizes.append(len(ids))
                found.append(np.flatnonzero(ids == end))
            ends = [f.tolist() for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("number"), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
                names=["file", "number", "n", "ends"],
            )

    return run


def scan(blocks: DataFrame, end: int = END, width: int = 2, group: int = 1024) -> DataFrame:
    """One row per document of flat token files: file, doc_no (from 0), first (place of its first id), n_tokens and closed.

    ``blocks`` has file, number and ids (``width`` bytes each, little-endian) in any order and with any
    block sizes; the numbers of a file order its blocks. Ends are searched in each block by itself. A prefix scan over the
    blocks' sizes and ends, first over groups of ``group`` blocks and then inside them, gives each block its offset, the
    number of documents before it and the last end before it, so that documents that cross blocks or files' groups
    are stitched. ``n_tokens`` is without the end; what follows the last end of a file is a row with ``closed`` false.
    Empty and null blocks count as no ids; an empty table gives no rows.
    """
    kind = dict(blocks.dtypes)["file"]
    found = blocks.select("file", "number", "ids").mapInArrow(_scanned(end, width), f"file {kind}, number long, n long, ends array<long>")
    found = found.withColumn("part", F.expr(f"number DIV {group}"))
    order = Window.partitionBy("file", "part").orderBy("number")
    inner = found.withColumns(
        {
            "offset": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "docs": F.coalesce(F.sum(F.size("ends")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    last = F.when(F.size("ends") > 0, F.col("offset") + F.element_at("ends", -1))
    inner = inner.withColumn("last", F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("own_last", last)
    parts = inner.groupBy("file", "part").agg(F.sum("n").alias("n"), F.sum(F.size("ends")).alias("docs"), F.max("own_last").alias("last"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"offset0": F.coalesce(F.sum("n").over(before), F.lit(0)), "docs0": F.coalesce(F.sum("docs").over(before), F.lit(0))})
    parts = parts.withColumn("last0", F.max(F.col("offset0") + F.col("last")).over(before))
    joined = inner.join(parts.select("file", "part", "offset0", "docs0", "last0"), ["file", "part"])
    start = F.coalesce(F.col("offset0") + F.col("last"), F.col("last0"), F.lit(-1)) + 1
    ends = F.transform("ends", lambda e: e + F.col("offset0") + F.col("offset"))
    closed = (
        joined.where(F.size("ends") > 0)
        .select("file", (F.col("docs0") + F.col("docs")).alias("docs"), start.alias("start"), ends.alias("ends"))
        .select("file", "docs", "start", "ends", F.posexplode("ends").alias("i", "at"))
        .select("file", (F.col("docs") + F.col("i")).alias("doc_no"), F.when(F.col("i") == 0, F.col("start")).otherwise(F.get("ends", F.col("i") - 1) + 1).alias("first"), "at")
        .select("file", "doc_no", "first", (F.col("at") - F.col("first")).alias("n_tokens"), F.lit(True).alias("closed"))
    )
    totals = parts.groupBy("file").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.max(F.col("offset0") + F.col("last")).alias("last"))
    rest = F.col("n") - (F.coalesce("last", F.lit(-1)) + 1)
    opened = totals.where(rest > 0).select(
        "file", F.col("docs").alias("doc_no"), (F.coalesce("last", F.lit(-1)) + 1).alias("first"), rest.alias("n_tokens"), F.lit(False).alias("closed")
    )
    return closed.unionByName(opened)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key``, file, doc_no and n_tokens of every row, counted by scanning the token files written from ``docs``.

    A null text counts as empty (0 ids). Repeated rows and null keys keep their rows; other columns are ignored.
    """
    blocks, names = write_stream(docs, key, text, vocabulary=vocabulary)
    named = names.select("file", F.posexplode("keys").alias("i", key), "number").select("file", (F.col("number") + F.col("i")).alias("doc_no"), key)
    return named.join(scan(blocks), ["file", "doc_no"]).select(key, "file", "doc_no", "n_tokens")
