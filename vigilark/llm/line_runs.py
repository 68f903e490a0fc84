"""Lines that many documents share, kept in one of them; what is known of lines lies in levelled sorted runs.

A run is a table of line hashes in buckets sorted by hash, with one row per line: the documents counted so far and
the greatest id. A batch of documents is merge-anti-joined with the runs: lines that a run already knows from enough
documents need no more counting, and the rest become a run of level 0. When a level has ``fan`` runs they are merged
into one of the next level. So a line of all documents is written in a few runs and then never again, and a row is
rewritten once per level. Runs share their buckets, so a join with a run does not move its rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.llm.hashing import slices
from vigilark.plans.chunked import in_chunks
from vigilark.plans.rounds import shared_folder, sized

# What is stripped from both ends of a line, and which letters are lowered.
BLANK = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PART = 1 << 20

SQL = r"""
    WITH lines AS (
        SELECT row_number() OVER () AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents
    ), keyed AS (
        SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
        FROM lines
    ), shared AS (
        SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 3
    ), told AS (
        SELECT r, doc_id, line, pos, shared.k IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone
        FROM keyed LEFT JOIN shared USING (k)
    )
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM told GROUP BY r, doc_id
"""


def keys_of(text: bytes) -> list[bytes]:
    """Per line the stripped text, lower-cased in A-Z."""
    return [line.strip(BLANK) for line in text.translate(LOWER).split(b"\n")]


def is_long(key: bytes, least: int) -> bool:
    """Whether the key has ``least`` code points or more."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (t or b"" for t in column.cast(pa.binary()).to_pylist())


def _keyed(least: int):
    """Each row's distinct long lines as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART):
            rows, found = [], []
            for i, text in enumerate(_texts(batch.column("text"))):
                own = {xxhash.xxh3_128_digest(k) for k in keys_of(text) if is_long(k, least)}
                found += own
                rows += [i] * len(own)
            at = pa.array(rows, pa.int64())
            rest = [batch.column(c).take(at) for c in ("batch", "doc", "text_hash")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *rest], names=["line", "batch", "doc", "text_hash"])

    return run


def _kept(least: int):
    """The text without the lines in ``gone``, and the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART):
            counts, dropped, texts = [], [], []
            for text, gone in zip(_texts(batch.column("text")), batch.column("gone").to_pylist()):
                lines = text.split(b"\n")
                kept = lines
                if gone:
                    out = set(gone)
                    kept = [w for w, k in zip(lines, keys_of(text)) if not (is_long(k, least) and xxhash.xxh3_128_digest(k) in out)]
                counts.append(len(lines))
                dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept))
            made = [pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            rest = [c for c in batch.schema.names if c not in ("text", "gone")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *made], names=[*rest, "n_lines", "n_dropped", "kept_text"])

    return run


class Runs:
    """Levelled runs of (line, n, keeper); a line counted from ``enough`` documents is not counted on.

    Runs are tables of this session's catalog in the shared folder; a merged run's table is dropped, and ``close``
    drops the rest. Every step writes before the next one reads, so a lost executor repeats one step at most.
    """

    def __init__(self, spark: SparkSession, enough: int, fan: int = 4):
        self.spark, self.enough, self.fan = spark, enough, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "line").sortBy("line").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _all(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Count a batch of (line, doc), each document once, where the runs do not already hold enough of them."""
        fresh = lines.distinct().groupBy("line").agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
        for name in self._all():
            known = self.spark.table(name).where(F.col("n") >= self.enough).select("line")
            fresh = fresh.join(known, "line", "left_anti")
        self._put(0, self._write(fresh))

    def _put(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan:
            names, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged(names))

    def _merged(self, names: Sequence[str]) -> str:
        if len(names) == 1:
            return names[0]
        # Read as plain files: Spark 4.1 takes a union of equally bucketed scans for bucketed too, but does not pair their buckets.
        rows = self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*[f"{self.folder}/{name}" for name in names])
        out = self._write(rows.groupBy("line").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper")))
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
        return out

    def shared(self) -> DataFrame:
        """(line, keeper) of the lines counted from enough documents, written."""
        names = self._all()
        if not names:
            return self.spark.createDataFrame([], "line binary, keeper long")
        self.levels = [[self._merged(names)]]
        return sized(self.spark.table(self.levels[0][0]).where(F.col("n") >= self.enough).select("line", "keeper"))

    def close(self) -> None:
        for name in self._all():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []


def drop_repeated_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text", enough: int = 3, least: int = 20, batches: int = 6, fan: int = 4
) -> DataFrame:
    """One row per row of ``df``: key, ``n_lines``, ``n_dropped`` and ``kept_text``.

    A text is cut at newlines. A line's key is the line without white space at its ends, A-Z lowered; where ``enough``
    documents hold a key of ``least`` code points, only the document of the greatest id keeps its lines. Batches of
    documents descend by id, so the first run to know a line has its keeper.

    A null text is one empty line, as is an empty one. Rows of one id are one document; a null id is one as well, the
    least. A document that loses all lines keeps an empty text. Equal rows stay as often as they come, an empty table
    gives no row, other columns are not read. A text of any length is handled whole by itself; its lines are told apart
    by 128-bit hashes. The ids must be numbers.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    cut = in_chunks(docs, "doc", batches).withColumnRenamed("_chunk", "batch")
    lines = cut.mapInArrow(_keyed(least), f"line binary, batch int, doc {df.schema[key].dataType.simpleString()}, text_hash long")
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    lines.write.partitionBy("batch").parquet(folder)
    lines = spark.read.schema(lines.schema).parquet(folder)
    runs = Runs(spark, enough, fan)
    try:
        for k in reversed(range(batches)):
            runs.add(lines.where(F.col("batch") == k).select("line", "doc"))
        shared = runs.shared()
    finally:
        runs.close()
    # A row is known by its id and text, as many rows may have no id; no row loses more lines than it has.
    lost = lines.join(shared, "line").where(~F.col("doc").eqNullSafe(F.col("keeper")))
    gone = lost.groupBy(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_set("line").alias("gone"))
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    joined = docs.join(gone, same, "left").select("doc", "text", "gone")
    shape = f"doc {df.schema[key].dataType.simpleString()}, n_lines long, n_dropped long, kept_text string"
    return joined.mapInArrow(_kept(least), shape).withColumnRenamed("doc", key)
