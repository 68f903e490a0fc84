"""Words and word windows of whole Arrow batches as 64-bit hashes, in numpy.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are lower-cased. Nothing here depends on
the process, so any task gives the same hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
SEGMENT = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the bounds of its rows in them; a null is an empty text."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds.astype(np.int64) - int(bounds[0])


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``size`` bytes of text each and at least one row."""
    for batch in batches:
        _, bounds = text_buffer(batch.column(column)) if batch.num_rows else (None, np.zeros(1, np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    inside = ~SEPARATOR[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[bounds] = True
    before = np.r_[False, inside[:-1]] if len(raw) else inside
    after = np.r_[inside[1:], False] if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each non-empty span; the spans must not overlap and be in order."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # a few megabytes at a time, as the work needs many bytes for each byte of text
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, "right")))
        long = ends[at:end] - starts[at:end]
        heads = np.cumsum(long) - long
        place = np.arange(int(long.sum())) - np.repeat(heads, long)
        values = _BYTE[LOWER[raw[place + np.repeat(starts[at:end], long)]]] * powers(int(long.max()))[place]
        out[at:end] = mix(np.add.reduceat(values, heads) + long.astype(np.uint64))
        at = end
    return out


def windows(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of ``size`` words that lie in one row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total += words[at + k] * _PLACE[k]
    return at, mix(total)


def shingle_sets(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct window hashes in order of (row, hash), and their rows.

    A text of fewer than ``size`` words, one at least, has one shingle: all its words.
    """
    raw, bounds = text_buffer(column)
    starts, ends, rows = spans(raw, bounds)
    words = hash_spans(raw, starts, ends)
    at, hashes = windows(words, rows, size)
    owner = rows[at]
    count = np.bincount(rows, minlength=len(column))
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        head = np.searchsorted(rows, short)
        total = count[short].astype(np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            total[has] += words[head[has] + k] * _PLACE[k + 32]
        hashes, owner = np.r_[hashes, mix(total)], np.r_[owner, short]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]
