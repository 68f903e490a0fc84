"""Quality of texts by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.llm.hashing import hash_spans, slices, spans, text_buffer, windows
from vigilark.plans.rounds import sized

NAMES = "log_words word_length symbols capitals digits points ended_lines repeated_lines repeated_windows distinct_words bars shouts same_again log_lines".split()


def _of(values: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(values.encode(), np.uint8)] = True
    return out


SYMBOLS, CAPITALS, DIGITS, POINTS, BARS, SHOUTS, ENDS = map(_of, ("#*$%&<>@^~_=+{}[]\\", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?", "|", "!", ".!?\"')"))


def _repeated(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one of the same owner."""
    order = np.lexsort((keys, owner))
    again = np.zeros(len(keys), bool)
    again[order[1:]] = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return again


def text_features(column: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` for every text, all from counts over the whole text; an empty text is all zeros."""
    raw, bounds = text_buffer(column)
    n = len(column)
    size = np.maximum(np.diff(bounds), 1)
    share = lambda table: (lambda c: (c[bounds[1:]] - c[bounds[:-1]]))(np.r_[0, np.cumsum(table[raw])])
    starts, ends, rows = spans(raw, bounds)
    words = hash_spans(raw, starts, ends)
    count = np.bincount(rows, minlength=n)
    some = np.maximum(count, 1)
    at, grams = windows(words, rows, 5)
    same = np.r_[False, (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])] if len(words) else np.zeros(0, bool)
    first = np.zeros(len(raw) + 1, bool)
    first[bounds] = True
    brk = raw == 10
    line_start = np.flatnonzero(~brk & (first[:-1] | np.r_[True, brk[:-1]][: len(raw)]))
    line_end = np.flatnonzero(~brk & (first[1:] | np.r_[brk[1:], True][: len(raw)])) + 1
    line_row = np.searchsorted(bounds, line_start, "right") - 1
    lines = np.bincount(line_row, minlength=n)
    line_hash = hash_spans(raw, line_start, line_end)
    ended = ENDS[raw[line_end - 1]] if len(line_end) else np.zeros(0, bool)
    per = lambda owner, flag: np.bincount(owner, flag, n)
    out = np.stack(
        [
            np.log1p(count),
            np.bincount(rows, ends - starts, n) / some,
            share(SYMBOLS) / some,
            share(CAPITALS) / size,
            share(DIGITS) / size,
            share(POINTS) / some,
            per(line_row, ended) / np.maximum(lines, 1),
            per(line_row, _repeated(line_hash, line_row)) / np.maximum(lines, 1),
            per(rows[at], _repeated(grams, rows[at])) / some,
            1 - per(rows, _repeated(words, rows)) / some,
            share(BARS) / some,
            share(SHOUTS) / some,
            per(rows, same) / some,
            np.log1p(lines),
        ],
        axis=1,
    )
    return np.where((count > 0)[:, None], out, 0.0)


class AdditiveModel:
    """Lookup tables per feature and per pair of features, learned by cyclic boosting of shallow trees.

    In each round every feature in turn gets a tree of three leaves over its bins, fitted to the
    logistic loss and added at a small rate. Then pairs, ranked by how much one cut on either axis would still
    lessen the loss, are boosted in the same way with trees of four leaves.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pairs: int = 5, pair_bins: int = 8, rate: float = 0.15, ridge: float = 2.0):
        cut = lambda k: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        self.cuts, self.pair_cuts = cut(bins), cut(pair_bins)
        rate_of = (y.sum() + 1) / (len(y) + 2)
        self.intercept = float(np.log(rate_of / (1 - rate_of)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if not len(x) or y.all() or not y.any():
            return
        place = self._bins(x, self.cuts)
        total = np.full(len(x), self.intercept)
        loss = lambda: (y - 1 / (1 + np.exp(-total)), np.maximum(1e-6, (p := 1 / (1 + np.exp(-total))) * (1 - p)))
        gain = lambda g, h: g * g / (h + ridge)
        for _ in range(rounds):
            for j, table in enumerate(self.tables):
                g, h = loss()
                g, h = np.bincount(place[j], g, len(table)), np.bincount(place[j], h, len(table))
                step = np.zeros(len(table))
                leaves = [(0, len(table))]
                for _ in range(2):
                    best = (1e-9, None)
                    for low, high in leaves:
                        a, b = np.cumsum(g[low:high]), np.cumsum(h[low:high])
                        if len(a) > 1:
                            gains = gain(a[:-1], b[:-1]) + gain(a[-1] - a[:-1], b[-1] - b[:-1]) - gain(a[-1], b[-1])
                            k = int(gains.argmax())
                            if gains[k] > best[0]:
                                best = (gains[k], (low, low + k + 1, high))
                    if best[1] is None:
                        break
                    low, mid, high = best[1]
                    leaves.remove((low, high))
                    leaves += [(low, mid), (mid, high)]
                for low, high in leaves:
                    step[low:high] = rate * g[low:high].sum() / (h[low:high].sum() + ridge)
                table += step
                total += step[place[j]]
        coarse = self._bins(x, self.pair_cuts)

        def best_cross(i: int, j: int):
            shape = (len(self.pair_cuts[i]) + 1, len(self.pair_cuts[j]) + 1)
            g, h = loss()
            cell = coarse[i] * shape[1] + coarse[j]
            sums = [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape).cumsum(0).cumsum(1) for v in (g, h)]
            if min(shape) < 2:
                return 0.0, None
            quarter = lambda s: (s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1], s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + s[:-1, :-1])
            gs, hs = map(quarter, sums)
            gains = sum(gain(a, b) for a, b in zip(gs, hs)) - gain(sums[0][-1, -1], sums[1][-1, -1])
            k = np.unravel_index(int(gains.argmax()), gains.shape)
            return float(gains[k]), (k, shape, [rate * a[k] / (b[k] + ridge) for a, b in zip(gs, hs)])

        ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -best_cross(*p)[0])
        self.pairs = [p for p in ranked[:pairs] if best_cross(*p)[1]]
        self.pair_tables = [np.zeros((len(self.pair_cuts[i]) + 1, len(self.pair_cuts[j]) + 1)) for i, j in self.pairs]
        for _ in range(rounds // 3):
            for (i, j), table in zip(self.pairs, self.pair_tables):
                (a, b), shape, values = best_cross(i, j)[1]
                step = np.zeros(shape)
                step[: a + 1, : b + 1], step[: a + 1, b + 1 :], step[a + 1 :, : b + 1], step[a + 1 :, b + 1 :] = values
                table += step
                total += step[coarse[i], coarse[j]]

    @staticmethod
    def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for table, place in zip(self.tables, self._bins(x, self.cuts)):
            total += table[place]
        if self.pairs:
            coarse = self._bins(x, self.pair_cuts)
            for (i, j), table in zip(self.pairs, self.pair_tables):
                total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        x = text_features(part.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("held_out"), lists], names=["doc", "held_out", "x"])


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES)) if batch.num_rows else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("held_out"), pa.array(model.value.score(x))], names=["doc", "held_out", "score"])

    return run


def quality_scores(
    docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = 20_000, least: float = 0.7
) -> DataFrame:
    """``key``, held_out, score (chance of label 1) and predicted (1 if score >= ``least``) of every row.

    The model is fitted on at most ``max_labelled`` labels, those of the least hash of their key, whose rows are
    not held out; null labels and keys are left out. Every text is described whole by counts of words,
    characters, lines and repeats. An empty or null text has all features zero and is scored like others; with
    no labels every score is 0.5. Repeated rows and null keys keep their rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    kind = dict(rows.dtypes)["doc"]
    described = sized(rows.mapInArrow(_described, f"doc {kind}, held_out boolean, x array<double>"))
    marks = labels.select(F.col(key).alias("_doc"), F.col(label).alias("y"))
    known = described.where("NOT held_out").join(marks.where("_doc IS NOT NULL AND y IS NOT NULL"), F.col("doc") == F.col("_doc"))
    some = known.select("x", F.col("y").cast("double").alias("y"), F.xxhash64("doc").alias("h")).orderBy("h", "x", "y").limit(max_labelled).toArrow()
    x = some.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES)) if some.num_rows else np.zeros((0, len(NAMES)))
    y = some.column("y").to_numpy() if some.num_rows else np.zeros(0)
    model = spark.sparkContext.broadcast(AdditiveModel(x, y))
    out = described.mapInArrow(_scores(model), f"doc {kind}, held_out boolean, score double")
    return out.select(F.col("doc").alias(key), "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"))
