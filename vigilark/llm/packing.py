"""Packing documents into fixed rows of token ids by best fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.llm.hashing import slices
from vigilark.llm.tokens import END, VOCABULARY, encode


class Capacities:
    """Open rows by the room they have left; a segment tree over the amounts finds the least that is enough."""

    def __init__(self, most: int):
        self.size = 1 << (most + 1).bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def _change(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) with the least room of ``need`` or more."""
        at = need + self.size
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.size
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Items of each row: items in decreasing length, each into the row with the least room that holds it."""
    rows: list[list[int]] = []
    open_rows = Capacities(capacity)
    for item in np.argsort(-lengths, kind="stable"):
        need = int(lengths[item])
        found = open_rows.take(need)
        room, row = found or (capacity, len(rows))
        if not found:
            rows.append([])
        rows[row].append(int(item))
        if room > need:
            open_rows.add(room - need, row)
    return rows


SCHEMA = (
    "shard int, row int, doc_ids array<long>, pieces array<int>, n_pieces array<int>, cu_seqlens array<int>, n_tokens int, input_ids binary, "
    "position_ids binary"
)


def _packed(length: int, end: int, path: str, batch_tokens: int):
    def write(shard: int, first: int, keys: list, pieces: list[np.ndarray], place: list[tuple[int, int]]) -> pa.RecordBatch:
        sizes = np.array([len(p) for p in pieces], np.int64)
        rows = best_fit(sizes, length)
        out: dict[str, list] = {k: [] for k in ("doc_ids", "pieces", "n_pieces", "cu_seqlens", "n_tokens", "input_ids", "position_ids")}
        for row in rows:
            used = sizes[row]
            total = int(used.sum())
            matrix = np.full(length, end, pieces[row[0]].dtype)
            matrix[:total] = np.concatenate([pieces[i] for i in row])
            resets = np.zeros(length, np.uint32)
            resets[:total] = np.arange(total) - np.repeat(np.cumsum(used) - used, used)
            out["doc_ids"].append([keys[i] for i in row])
            out["pieces"].append([place[i][0] for i in row])
            out["n_pieces"].append([place[i][1] for i in row])
            out["cu_seqlens"].append([0, *np.cumsum(used).tolist()])
            out["n_tokens"].append(total)
            out["input_ids"].append(matrix.tobytes())
            out["position_ids"].append(resets.tobytes())
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard] * len(rows), pa.int32()),
                pa.array(range(first, first + len(rows)), pa.int32()),
                *[pa.array(v, t) for v, t in zip(out.values(), kinds)],
            ],
            names=["shard", "row", *out],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first = TaskContext.get().partitionId(), 0
        keys: list = []
        pieces: list[np.ndarray] = []
        place: list[tuple[int, int]] = []
        held = 0
        for part in slices(batches, "text", 1 << 20):
            ids, count = encode(part.column("text").to_pylist(), path)
            at = 0
            for key, n in zip(part.column("doc").to_pylist(), count.tolist()):
                own = np.append(ids[at : at + n], np.array([end], ids.dtype))
                at += n
                cuts = range(0, n + 1, length)
                for k, low in enumerate(cuts):
                    keys.append(key)
                    pieces.append(own[low : low + length])
                    place.append((k, len(cuts)))
                held += n + 1
                if held >= batch_tokens:
                    done = write(shard, first, keys, pieces, place)
                    first += done.num_rows
                    yield done
                    keys, pieces, place, held = [], [], [], 0
        if keys:
            yield write(shard, first, keys, pieces, place)

    return run


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = 2048,
    end: int = END,
    vocabulary: str = VOCABULARY,
    batch_tokens: int = 1 << 20,
) -> DataFrame:
    """Rows of ``length`` token ids, filled with whole documents where they fit.

    Each document's ids and one ``end`` are cut into pieces of ``length``, the last one shorter; the pieces
    of about ``batch_tokens`` are packed by best fit decreasing. Each input split is a shard by
    itself: no row moves, and memory is bounded by the batch and the longest document.

    Returns shard, row, doc_ids, pieces (which piece of its document), n_pieces (of how many),
    cu_seqlens (bounds of the pieces from 0), n_tokens (the last bound), input_ids (``length`` ids as
    little-endian uint16, or uint32 for larger vocabularies, padded with ``end``) and position_ids (uint32, from 0 in every
    piece). A null text counts as empty: one piece with the end only. Null keys are carried as
    null; repeated rows are packed each; other columns are ignored. No row for an empty table.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(_packed(length, end, vocabulary, batch_tokens), SCHEMA)
