"""Language-model score of texts by prediction by partial matching over bytes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.llm.hashing import LOWER, hash_spans, mix, slices, spans, text_buffer
from vigilark.plans.rounds import sized

GRAM = np.uint64(0xD6E8FEB86659FD93)


def token_bytes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes to be predicted, the row of each, and the words' bounds and rows.

    A text is its words, A-Z lower-cased, with one space (32) after each, and one end (0).
    """
    starts, ends, rows = spans(raw, bounds)
    n = len(bounds) - 1
    long = ends - starts + 1
    per_row = np.bincount(rows, long, n).astype(np.int64) + 1
    begin = np.cumsum(per_row) - per_row
    flat = np.full(int(per_row.sum()), 32, np.uint8)
    flat[begin + per_row - 1] = 0
    if len(starts):
        heads = np.cumsum(long) - long
        inside = np.arange(int(long.sum())) - np.repeat(heads, long)
        target = np.arange(int(long.sum())) + np.repeat(rows, long)  # one end for each row before
        word = inside < np.repeat(long - 1, long)
        flat[target[word]] = LOWER[raw[(inside + np.repeat(starts, long))[word]]]
    return flat, np.repeat(np.arange(n), per_row), starts, ends, rows


def contexts(flat: np.ndarray, row: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` bytes before each byte as a number; before a text come zeros."""
    out = np.zeros(len(flat), np.uint64)
    for k in range(order, 0, -1):
        shifted = np.zeros(len(flat), np.uint64)
        if k < len(flat):
            shifted[k:] = np.where(row[k:] == row[:-k], flat[:-k], 0)
        out = (out << np.uint64(8)) | shifted
    return out


def _counted(order: int):
    """Grams of ``order`` bytes and the next byte with their counts, combined over a few slices of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def combined() -> tuple[np.ndarray, np.ndarray]:
            keys, count = (np.concatenate(x) for x in zip(*held))
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, count).astype(np.int64)

        for part in slices(batches, "text"):
            raw, bounds = text_buffer(part.column("text"))
            flat, row, *_ = token_bytes(raw, bounds)
            keys, count = np.unique((contexts(flat, row, order) << np.uint64(8)) | flat, return_counts=True)
            held.append((keys, count))
            if sum(len(k) for k, _ in held) > 4_000_000:
                held = [combined()]
                if len(held[0][0]) > 3_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["gram", "n"])
                    held = []
        if held:
            keys, count = combined()
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(count)], names=["gram", "n"])

    return run


class Table:
    """64-bit keys to places, by open addressing; at most half full."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        waiting, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(waiting):
            free = self.slots[at] < 0
            self.slots[at[free]] = waiting[free]  # of several for one slot the last stays
            lost = self.slots[at] != waiting
            waiting, at = waiting[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * GRAM) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._slot(keys)
        place = self.slots[at]
        wrong = np.flatnonzero((place >= 0) & (self.keys[place] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            place[wrong] = self.slots[at[wrong]]
            p = place[wrong]
            wrong = wrong[(p >= 0) & (self.keys[p] != keys[wrong])]
        return place


def _levels(grams: DataFrame, order: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """For each order the grams with their counts, and the contexts with their escapes; each a table as large as it needs to be.

    Escapes are by method C with exclusion of the symbols of longer contexts. In a context seen n times with d symbols, a symbol seen c times
    has c / (n + d) and the escape d / (n + d). After an escape, the symbols of the longer context cannot follow; they are a
    subset of those of the shorter one, so n and d less their share depend on the longer context alone and are kept with it.
    """
    counts = [grams.select(F.col("gram").alias("g"), F.col("n").alias("c"))]
    for k in range(order - 1, -1, -1):
        counts.insert(0, sized(counts[0].groupBy(_last("g", k + 1).alias("g")).agg(F.sum("c").alias("c"))))
    contexts_ = []
    for k, level in enumerate(counts):
        context = F.shiftrightunsigned("g", 8).alias("x")
        if not k:
            contexts_.append(sized(level.groupBy(context).agg(F.sum("c").alias("n"), F.count("*").alias("d")).withColumns({"n_less": F.lit(0), "d_less": F.lit(0)})))
            continue
        shorter = counts[k - 1].select(F.col("g").alias("_g"), F.col("c").alias("own"))
        own = level.join(shorter, _last("g", k) == F.col("_g"))
        sums = own.groupBy(context).agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.sum("own").alias("own"))
        below = contexts_[k - 1].select(F.col("x").alias("_x"), F.col("n").alias("_n"), F.col("d").alias("_d"))
        joined = sums.join(below, _last("x", k - 1) == F.col("_x"))
        contexts_.append(sized(joined.select("x", "n", "d", (F.col("_n") - F.col("own")).alias("n_less"), (F.col("_d") - F.col("d")).alias("d_less"))))
    return counts, contexts_


def _last(name: str, size: int):
    """The last ``size`` bytes of a gram or context."""
    return F.col(name).bitwiseAND((1 << (8 * size)) - 1 if size < 8 else -1)


def _unseen(wanted: DataFrame, counts: list[DataFrame], contexts_: list[DataFrame], symbols: int) -> DataFrame:
    """log10 probability of grams, from the longest context down; after order 0 the symbols not seen in training are alike."""
    none = F.lit(None).cast("double")
    rows = wanted.select("gram", F.lit(0.0).alias("sum"), none.alias("value"), none.alias("nl"), none.alias("dl"))
    for k in range(len(counts) - 1, -1, -1):
        rows = rows.withColumns({"_g": _last("gram", k + 1), "_x": F.shiftrightunsigned(_last("gram", k + 1), 8)})
        rows = rows.join(counts[k], F.col("_g") == F.col("g"), "left").join(contexts_[k], F.col("_x") == F.col("x"), "left")
        open_, fresh = F.col("value").isNull(), F.col("nl").isNull()
        n, d = F.when(fresh, F.col("n")).otherwise(F.col("nl")), F.when(fresh, F.col("d")).otherwise(F.col("dl"))
        hit = open_ & F.col("c").isNotNull()
        # Where no symbol is left the escape is certain.
        escape = F.when(open_ & F.col("c").isNull() & F.col("x").isNotNull() & (d > 0), F.log10(d) - F.log10(n + d)).otherwise(0.0)
        rows = rows.select(
            "gram",
            (F.col("sum") + escape).alias("sum"),
            F.when(hit, F.col("sum") + F.log10("c") - F.log10(n + d)).otherwise(F.col("value")).alias("value"),
            F.col("n_less").cast("double").alias("nl"),
            F.col("d_less").cast("double").alias("dl"),
        )
    return rows.select("gram", F.coalesce("value", F.col("sum") - math.log10(max(1, 256 - symbols))).alias("p"))


def _scored(cache, order: int, frequent, n_train: int, n_types: int, learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, logs = cache.value
        near = Table(grams)
        words, counts = frequent.value
        known = Table(words)
        task, at = TaskContext.get().partitionId(), 0
        log = lambda c: np.log10((c + 0.5) / (n_train + 0.5 * (n_types + 1)))
        for part in slices(batches, "text"):
            raw, bounds = text_buffer(part.column("text"))
            flat, row, starts, ends, rows = token_bytes(raw, bounds)
            n = part.num_rows
            keys = (contexts(flat, row, order) << np.uint64(8)) | flat
            place = near.find(keys)
            far = place < 0
            score = np.bincount(row[~far], logs[place[~far]], n).astype(np.float64)  # of no rows it makes integers
            far_cuts = np.searchsorted(row[far], np.arange(n + 1)).astype(np.int32)
            hashes = hash_spans(raw, starts, ends)
            place = known.find(hashes)
            hit = place >= 0
            c = counts[place[hit]].astype(np.float64)
            base = np.bincount(rows[hit], log(c), n) + log(float(learned))
            found = np.bincount(rows[hit], c > 0, n).astype(np.int64) + (learned > 0)
            rest, owner = hashes[~hit].view(np.int64), rows[~hit]
            cuts = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((np.int64(task) << 33) + np.arange(at, at + n)),
                    part.column("doc"),
                    part.column("held_out"),
                    pa.array(np.bincount(rows, minlength=n).astype(np.int64) + 1),
                    pa.array(found),
                    pa.array(base),
                    pa.array(score),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(rest)),
                    pa.ListArray.from_arrays(pa.array(far_cuts), pa.array(keys[far].view(np.int64))),
                ],
                names=["row", "doc", "held_out", "n_tokens", "n_known", "base", "score", "rest", "far"],
            )
            at += n

    return run


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of a part with how often they occur, in all and in training rows."""
    for part in slices(batches, "text", 16 << 20):
        raw, bounds = text_buffer(part.column("text"))
        starts, ends, rows = spans(raw, bounds)
        train = ~np.asarray(part.column("held_out").to_numpy(zero_copy_only=False), bool)
        keys, at = np.unique(hash_spans(raw, starts, ends), return_inverse=True)
        learned = np.bincount(at, train[rows], len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64)), pa.array(learned)], names=["word", "n", "c"])


def _least_count(grams: DataFrame, most: int) -> DataFrame:
    """The grams of the least count at which they are ``most`` or fewer; from 1024 on counts are taken by powers of two."""
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.pow(F.lit(2), F.floor(F.log2("n"))).cast("long"))
    sizes = [(r["step"], r["grams"]) for r in grams.groupBy(step.alias("step")).agg(F.count("*").alias("grams")).orderBy(F.col("step").desc()).collect()]
    held, least = 0, None
    for n, many in sizes:
        if held + many > most:
            break
        held, least = held + many, n
    return grams.where(F.col("n") >= least) if least is not None else grams.limit(0)


def _most(grams: DataFrame, most: int) -> DataFrame:
    """``most`` grams at most: those of the least count that fits, or of counts of a thousand and more the most frequent."""
    sizes = [(r["n"], r["grams"]) for r in grams.where("n < 1000").groupBy("n").agg(F.count("*").alias("grams")).orderBy("n").collect()]
    left, least = grams.count(), 1
    for n, many in sizes:
        if left <= most:
            break
        left, least = left - many, n + 1
    return grams.orderBy(F.col("n").desc(), "gram").limit(most) if left > most else grams.where(F.col("n") >= least)


def ppm_scores(
    docs: DataFrame,
    held_out,
    key: str = "doc_id",
    text: str = "text",
    order: int = 5,
    max_grams: int | None = None,
    max_frequent: int = 100_000,
    cache_grams: int = 1_500_000,
) -> DataFrame:
    """log10 probability of every text by a byte-level PPM model learned from the rows where ``held_out`` is false.

    Grams of ``order`` bytes and the next byte are counted over all training rows; shorter contexts
    follow from them. The counts of every order are tables that grow with the input, and none is dropped. The most frequent grams, ``cache_grams`` at most, are
    sent to the tasks with their probabilities (24 MB); all others, and grams not seen in training, are joined. Only if a caller gives ``max_grams``
    is the model cut to that many grams, by the least count at which they fit; its shorter contexts are then those of the grams that stay.
    ``base_score`` is that of a unigram model of words with 0.5 added. Its counts are exact: the
    ``max_frequent`` most frequent words are sent to the tasks, all others are joined by their hash.

    Returns ``key``, held_out, n_tokens, n_known, train_tokens, base_score and score. Texts are words (A-Z lower-cased), each with a
    space after it, and an end; the end is a token. A null or blank text is the end alone. Null keys keep their rows, repeated rows are scored
    each, other columns are ignored; with no training rows every byte is alike. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    grams = sized(
        rows.where("NOT held_out").select("text").mapInArrow(_counted(order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    )
    if max_grams is not None:
        grams = sized(_most(grams, max_grams))
    counts, contexts_ = _levels(grams, order)
    symbols = counts[0].count()
    column = lambda t, name, kind=np.int64: t.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(kind)
    escaped = contexts_[order].select("x", F.col("n").alias("_n"), "d")
    seen = lambda some: some.join(escaped, F.shiftrightunsigned("gram", 8) == F.col("x")).select("gram", (F.log10("n") - F.log10(F.col("_n") + F.col("d"))).alias("p"))
    top = seen(_least_count(grams, cache_grams)).toArrow()
    cache = spark.sparkContext.broadcast((column(top, "gram").view(np.uint64), column(top, "p", np.float64)))
    words = sized(rows.select("text", "held_out").mapInArrow(_word_hashes, "word long, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c")))
    ends = rows.agg(F.sum(F.when(F.col("held_out"), 0).otherwise(1)).alias("x")).first()["x"] or 0
    sums = words.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("v")).first()
    n_train, n_types = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    top = words.orderBy(F.col("n").desc(), "word").limit(max_frequent).toArrow()
    frequent = spark.sparkContext.broadcast((column(top, "word").view(np.uint64), column(top, "c")))
    kind = dict(rows.dtypes)["doc"]
    schema = f"row long, doc {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<long>, far array<long>"
    scored = sized(rows.mapInArrow(_scored(cache, order, frequent, n_train, n_types, ends), schema))
    rest = scored.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k")).join(words.select("word", "c"), "word")
    more = rest.groupBy("row").agg(
        F.sum(F.col("k") * F.log10((F.col("c") + 0.5) / (n_train + 0.5 * (n_types + 1)))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known")
    )
    far = sized(scored.select("row", F.explode("far").alias("gram")).groupBy("row", "gram").agg(F.count("*").alias("k")))
    wanted = far.select("gram").distinct()
    known = seen(grams.join(wanted, "gram", "left_semi"))
    chances = sized(known.unionByName(_unseen(wanted.join(grams, "gram", "left_anti"), counts, contexts_, symbols)))
    rare = far.join(chances, "gram").groupBy("row").agg(F.sum(F.col("k") * F.col("p")).alias("rare"))
    return scored.drop("rest", "far").join(more, "row", "left").join(rare, "row", "left").select(
        F.col("doc").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare", F.lit(0.0))).alias("score"),
    )
