"""Language of texts by cross-parsing against suffix automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark.llm.hashing import LOWER, slices, text_buffer
from vigilark.plans.rounds import sized

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
SEGMENT = 512


def normalised(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and single spaces of each row, as bytes with their bounds.

    Bytes beyond ASCII stay, capitals of Latin-1 are lower-cased; each row begins with a space.
    """
    low = LOWER[raw]
    if len(raw) > 1:
        capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
        low[1:][capital] += 32
    low = np.where(LETTER[raw], low, np.uint8(32))
    first = np.zeros(len(raw) + 1, bool)
    first[bounds] = True
    keep = (low != 32) | np.r_[True, (low[:-1] != 32) | first[1:-1]][: len(raw)] if len(raw) else np.zeros(0, bool)
    keep = keep & ~((low == 32) & first[: len(raw)])
    count = np.r_[0, np.cumsum(keep)]
    per_row = count[bounds[1:]] - count[bounds[:-1]] + 1
    ends = np.r_[0, np.cumsum(per_row)]
    out = np.full(int(ends[-1]), 32, np.uint8)
    body = np.ones(len(out), bool)
    body[ends[:-1]] = False
    out[body] = low[keep]
    return out, ends


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the least automaton of all substrings; state 0 is the start."""
    following: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for symbol in data:
        new = len(following)
        following.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        at = last
        while at != -1 and symbol not in following[at]:
            following[at][symbol] = new
            at = link[at]
        if at != -1:
            target = following[at][symbol]
            if longest[at] + 1 == longest[target]:
                link[new] = target
            else:
                copy = len(following)
                following.append(dict(following[target]))
                link.append(link[target])
                longest.append(longest[at] + 1)
                while at != -1 and following[at].get(symbol) == target:
                    following[at][symbol] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return following


class Parser:
    """The automata of all languages in one table of state and symbol."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        used = sorted({b for s in samples.values() for b in s})
        self.symbol = np.full(256, len(used), np.int64)
        self.symbol[used] = np.arange(len(used))
        self.width = len(used) + 1
        tables, self.roots, self.weight = [], [], []
        at = 0
        for name in self.languages:
            following = suffix_automaton(samples[name])
            table = np.full((len(following), self.width), -1, np.int32)
            for state, moves in enumerate(following):
                for symbol, target in moves.items():
                    table[state, self.symbol[symbol]] = target + at
            tables.append(table)
            self.roots.append(at)
            self.weight.append(np.log2(len(samples[name]) + 2))
            at += len(following)
        self.dead = at  # after an unknown byte: whatever follows begins a phrase
        self.table = np.concatenate([*tables, np.full((1, self.width), -1, np.int32)]).ravel()

    def phrases(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many phrases each row falls into by each language: the longest known string again and again.

        Pieces of ``SEGMENT`` bytes are first parsed side by side, each as if a phrase began with it. Then each is
        parsed again from the state in which the piece before it ends, up to the first byte at which a phrase begins
        either way: from there on both are the same. Where no such byte comes, the piece after it follows in another round.
        """
        sizes = np.diff(ends)
        many = np.maximum(-(-sizes // SEGMENT), 1)
        owner = np.repeat(np.arange(len(sizes)), many)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        start = ends[:-1][owner] + part * SEGMENT
        long = np.minimum(sizes[owner] - part * SEGMENT, SEGMENT)
        symbols = self.symbol[flat]
        alone, end, begun = self._alone(symbols, start, long)
        count, alone_end = alone.copy(), end.copy()
        entered = np.full(end.shape, self.dead, np.int64)
        follow = np.flatnonzero(part > 0)
        first_round = True
        while True:
            language, piece = np.nonzero(entered[:, follow] != end[:, follow - 1])
            if not len(piece):
                break
            piece = follow[piece]
            if not first_round:  # the first of each row and language: all before it are as they should be
                new = np.r_[True, (language[1:] != language[:-1]) | (owner[piece[1:]] != owner[piece[:-1]])]
                language, piece = language[new], piece[new]
            first_round = False
            state = entered[language, piece] = end[language, piece - 1]
            more, last = self._joined(symbols, begun, state, language, start[piece], long[piece], alone_end[language, piece])
            count[language, piece] = alone[language, piece] + more
            end[language, piece] = last
        out = np.zeros((len(self.roots), len(sizes)), np.int64)
        for k in range(len(out)):
            out[k] = np.bincount(owner, count[k], len(sizes))
        return out

    def _step(self, state: np.ndarray, root: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one more byte, and where a phrase begins with it."""
        move = self.table[state * self.width + own]
        begins = move < 0
        again = self.table[root * self.width + own]
        return np.where(begins, np.where(again < 0, self.dead, again), move), begins

    def _alone(self, symbols: np.ndarray, start: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases and last state of each piece by each language, and the bytes at which phrases begin."""
        order = np.argsort(-long, kind="stable")
        start, long = start[order], long[order]
        root = np.array(self.roots, np.int64)[:, None]
        state = np.full((len(root), len(start)), self.dead, np.int64)
        count = np.zeros((len(root), len(start)), np.int64)
        begun = np.zeros((len(root), len(symbols)), bool)
        for j in range(int(long[0]) if len(long) else 0):
            a = int(np.searchsorted(-long, -j, "left"))  # pieces longer than j
            state[:, :a], begins = self._step(state[:, :a], root, symbols[start[:a] + j][None, :])
            count[:, :a] += begins
            begun[:, start[:a] + j] = begins
        back = np.argsort(order)
        return count[:, back], state[:, back], begun

    def _joined(self, symbols, begun, state, language, start, long, alone_end) -> tuple[np.ndarray, np.ndarray]:
        """How many phrases more than alone each piece has if entered in ``state``, and its last state then."""
        root = np.array(self.roots, np.int64)[language]
        more, last = np.zeros(len(start), np.int64), alone_end.copy()
        open_ = np.arange(len(start))
        for j in range(int(long.max())):
            over = long[open_] <= j
            if over.any():
                last[open_[over]] = state[over]
                open_, state = open_[~over], state[~over]
            if not len(open_):
                break
            at = start[open_] + j
            state, begins = self._step(state, root[open_], symbols[at])
            before = begun[language[open_], at]
            more[open_] += begins.astype(np.int64) - before
            apart = ~(begins & before)
            open_, state = open_[apart], state[apart]
        last[open_] = state
        return more, last


_parsers: dict[int, Parser] = {}


def _labelled(model, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _parsers:
            _parsers.clear()
            _parsers[number] = Parser(model.value)
        parser = _parsers[number]
        for part in slices(batches, "text"):
            raw, bounds = text_buffer(part.column("text"))
            flat, ends = normalised(raw, bounds)
            letters = np.r_[0, np.cumsum(LETTER[raw])]
            ascii_ = np.r_[0, np.cumsum(LETTER[raw] & (raw < 128))]
            some = letters[bounds[1:]] > letters[bounds[:-1]]
            for i in np.flatnonzero(some & (ascii_[bounds[1:]] == ascii_[bounds[:-1]])):
                some[i] = any(c.isalpha() for c in part.column("text")[int(i)].as_py())
            n = part.num_rows
            if parser.languages:
                bits = parser.phrases(flat, ends) * np.array(parser.weight)[:, None]
                best = bits.argmin(axis=0)
                ranked = np.sort(bits, axis=0)
                second = ranked[1] if len(ranked) > 1 else np.full(n, np.inf)
                score = np.where(np.isinf(second), 1.0, second / (second + ranked[0]))
                names = np.array([*parser.languages, "und"], object)[np.where(some, best, len(parser.languages))]
                bits_per_byte = ranked[0] / np.diff(ends)
            else:
                names, score, bits_per_byte = np.full(n, "und", object), np.zeros(n), np.zeros(n)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(some, score, 0.0)), pa.array(np.where(some, bits_per_byte, 0.0))],
                names=["doc", "held_out", "lang_pred", "score", "bits_per_byte"],
            )

    return run


def languages(
    docs: DataFrame,
    held_out: Column,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_bytes: int = 20_000,
    total_bytes: int = 200_000,
    sample_docs: int = 64,
    piece_chars: int = 4000,
) -> DataFrame:
    """``key``, held_out, lang_pred, score and bits_per_byte of every row.

    Of each language at most ``sample_docs`` distinct texts of labelled rows with ``held_out`` false, those of the least hash,
    give at most ``sample_bytes`` bytes in equal parts (``total_bytes`` for all languages together), each from a piece of at most
    ``piece_chars`` characters at an offset drawn from the text's hash: this sample is all that is learned. Its suffix automaton tells the longest strings of a text that the language knows; the
    number of such phrases times log2 of the sample's size is the text's cross-entropy, and the least wins, the first by
    name in a tie. ``score`` is the share of the second best in the sum of both best (0.5 to 1).

    A null text or one without a letter is ``und`` with score 0, and so is all if nothing is labelled. Texts are parsed
    whole: a phrase may be as long as the sample. Null keys and repeated rows keep their rows; other columns are ignored.
    """
    import random

    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(lang).alias("lang"))
    known = rows.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    # Hashes are ranked without their texts: one row per distinct text is shuffled.
    ranked = known.select("lang", "h").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    offset = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - piece_chars + 1, F.lit(1)).cast("long")).cast("int") + 1
    piece = F.substring("text", offset, F.lit(piece_chars)).alias("text")
    first = known.join(sized(ranked.where(F.col("k") <= sample_docs)), ["lang", "h"]).groupBy("lang", "k").agg(F.min(piece).alias("text"))
    texts: dict[str, list[str]] = {}
    for r in first.orderBy("lang", "k").select("lang", "text").toArrow().to_pylist():
        texts.setdefault(r["lang"], []).append(r["text"])
    most = min(sample_bytes, total_bytes // max(1, len(texts)))
    samples = {}
    for name, own in texts.items():
        flat, ends = normalised(*text_buffer(pa.array(own, pa.string())))
        share = max(1, most // len(own))
        joined = b"".join(flat[a : min(b, a + share)].tobytes() for a, b in zip(ends, ends[1:]))
        if joined.strip():
            samples[name] = joined[:most]
    model = spark.sparkContext.broadcast(samples)
    kind = dict(rows.dtypes)["doc"]
    schema = f"doc {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double"
    out = rows.drop("lang").mapInArrow(_labelled(model, random.getrandbits(60)), schema)
    return out.withColumnRenamed("doc", key)
