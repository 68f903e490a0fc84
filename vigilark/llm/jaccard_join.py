"""Similarity join of texts on their word shingles, by recursive splitting on sampled tokens."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.llm.hashing import mix, shingle_sets, slices
from vigilark.operators.links import linked_groups
from vigilark.plans.rounds import shared_folder, sized

WIDTH = 128  # entries of a sketch
SLACK = 0.28  # of 128 entries at 0.8, as many as 0.28 fewer than expected agree with a chance of about 10^-12
PIECE = 1 << 15
_random = np.random.default_rng(20240611)
_FLIP = _random.integers(0, 2**63, WIDTH, dtype=np.uint64)
_TIMES = _random.integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW = "set_id long, doc long, text_hash long, n_shingles int, low binary, high binary"


def _runs(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each row's run in a sorted ``owner``."""
    count = np.bincount(owner, minlength=n)
    return np.cumsum(count) - count, count


def sketches(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """``WIDTH`` values per row: the least of its hashes under each of ``WIDTH`` reorderings, as 32 bits.

    Two sets agree in each value by itself with the chance of their Jaccard similarity, whatever their size.
    """
    out = np.zeros((n, WIDTH), np.uint32)
    start, count = _runs(owner, n)
    some = np.flatnonzero(count)
    at = 0
    while at < len(some):  # pieces that stay in the processor's cache
        end = max(at + 1, int(np.searchsorted(start[some], start[some[at]] + PIECE)))
        rows = some[at:end]
        low = start[rows[0]]
        piece = hashes[low : start[rows[-1]] + count[rows[-1]]]
        for j in range(WIDTH):
            out[rows, j] = mix(np.minimum.reduceat((piece ^ _FLIP[j]) * _TIMES[j], start[rows] - low)) >> np.uint64(32)
        at = end
    return out


def _set_ids(hashes: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of each whole set; 0 for an empty one."""
    out = np.zeros(len(count), np.uint64)
    some = count > 0
    if some.any():
        out[some] = mix(np.add.reduceat(mix(hashes + np.uint64(0x51ED27)), start[some]) + count[some].astype(np.uint64))
    return out


def _described(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, owner = shingle_sets(part.column("text"), size)
            start, count = _runs(owner, part.num_rows)
            planes = sketches(hashes, owner, part.num_rows).view(np.uint8).reshape(-1, WIDTH, 4)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_set_ids(hashes, start, count).view(np.int64)),
                    part.column("doc"),
                    part.column("text_hash"),
                    pa.array(count.astype(np.int32)),
                    *(pa.array([x.tobytes() for x in p], pa.binary()) for p in (planes[:, :, 0], planes[:, :, 1:])),
                ],
                names=["set_id", "doc", "text_hash", "n_shingles", "low", "high"],
            )

    return run


def _whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, owner = shingle_sets(part.column("text"), size)
            start, count = _runs(owner, part.num_rows)
            ids = _set_ids(hashes, start, count).view(np.int64)
            same = np.flatnonzero(ids == np.asarray(part.column("wanted")))
            sets = [hashes[start[i] : start[i] + count[i]].tobytes() for i in same]
            yield pa.RecordBatch.from_arrays([pa.array(ids[same]), pa.array(sets, pa.binary())], names=["set_id", "shingles"])

    return run


def _chosen(path: np.ndarray, branch: int) -> np.ndarray:
    """The ``branch`` entries that each path splits on, sampled by a hash of the path."""
    scores = mix(path[:, None] ^ mix(np.arange(1, WIDTH + 1, dtype=np.uint64))[None, :])
    return np.argpartition(scores, branch, axis=1)[:, :branch]


def _as_matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _children(branch: int):
    """One row per path and chosen entry: the path extended by the entry and its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            low = _as_matrix(batch.column("low"), np.uint8, WIDTH)
            high = _as_matrix(batch.column("high"), np.uint8, 3 * WIDTH).reshape(-1, WIDTH, 3)
            path = np.ascontiguousarray(np.asarray(batch.column("path")).view(np.uint64))
            entry = _chosen(path, branch)
            value = np.take_along_axis(low, entry, axis=1).astype(np.uint64)
            for k in range(3):
                value |= np.take_along_axis(high[:, :, k], entry, axis=1).astype(np.uint64) << np.uint64(8 * (k + 1))
            new = mix(mix(path[:, None] + entry.astype(np.uint64)) ^ (value << np.uint64(8)))
            each = np.repeat(np.arange(len(path)), branch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(new.ravel().view(np.int64)), batch.column("set_id").take(each), batch.column("n").take(each)],
                names=["path", "set_id", "above"],
            )

    return run


def _ties(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fewest pairs that connect what ``pairs`` connect: each id and the least one tied to it."""
    ids, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(ids))
    changed = True
    while changed:
        old = root.copy()
        np.minimum.at(root, a, old[b])
        np.minimum.at(root, b, old[a])
        root = root[root]
        changed = (old != root).any()
    other = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[other]], ids[other]


def _alike(limit: int, least: float):
    """Ties between sets of one path whose sketches agree in ``least`` of their entries; rows come sorted by path.

    A batch starts again with the last ``limit`` rows of the one before, and gives as many ties as connect its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            path, ids = np.asarray(batch.column("path")), np.asarray(batch.column("set_id"))
            sketch = _as_matrix(batch.column("low"), np.uint8, WIDTH)
            kept = 0
            if tail is not None:
                kept = len(tail[0])
                path, ids, sketch = np.r_[tail[0], path], np.r_[tail[1], ids], np.r_[tail[2], sketch]
            found = []
            for d in range(1, limit):
                i = np.flatnonzero(path[d:] == path[:-d])
                i = i[i + d >= kept]
                if len(i):
                    i = i[(sketch[i] == sketch[i + d]).mean(axis=1) >= least]
                    found.append(np.stack([ids[i], ids[i + d]]))
            tail = path[-limit:], ids[-limit:], sketch[-limit:]
            if found:
                a, b = _ties(np.concatenate(found, axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _bucketed(df: DataFrame, key: str) -> tuple[str, DataFrame]:
    """Write a table in buckets of ``key`` to the shared folder: a join on it moves the other side only."""
    spark = df.sparkSession
    name = f"sets_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return name, spark.table(name)


def _candidates(sets: DataFrame, runs: int, branch: int, limit: int, least: float) -> DataFrame:
    """Edges between sets that may be similar, enough to connect all similar ones."""
    spark = sets.sparkSession
    bare = sets.select("set_id", "low", "high")
    roots = bare.withColumn("path", F.explode(F.array(*[F.lit(r + 1).cast("long") for r in range(runs)])))
    rows = sized(roots.withColumn("n", F.lit(None).cast("long")).mapInArrow(_children(branch), "path long, set_id long, above long"))
    small, edges = [], []
    while True:
        buckets = sized(
            rows.groupBy("path")
            .agg(F.count("*").alias("n"), F.max("above").alias("above"), F.min("set_id").alias("root"))
            .where("n > 1")
            .withColumn("kind", F.when(F.col("n") <= limit, "small").when(F.col("n") > 0.6 * F.col("above"), "alike").otherwise("large"))
        )
        members = sized(rows.join(buckets.drop("above"), "path"))
        small.append(members.where("kind = 'small'").select("path", "set_id"))
        edges.append(members.where("kind = 'alike' and set_id <> root").select(F.col("root").alias("a"), F.col("set_id").alias("b")))
        large = members.where("kind = 'large'").select("path", "set_id", "n")
        if large.isEmpty():
            break
        rows = sized(large.join(bare, "set_id").select("path", "set_id", "n", "low", "high").mapInArrow(_children(branch), "path long, set_id long, above long"))
    # The small buckets of all levels are compared in one pass: a path tells its level, too.
    in_small = reduce(DataFrame.unionByName, small).join(sets.select("set_id", "low"), "set_id").select("path", "set_id", "low")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    compared = in_small.repartition(parts, "path").sortWithinPartitions("path", "set_id").mapInArrow(_alike(limit, least), "a long, b long")
    return sized(reduce(DataFrame.unionByName, edges, compared))  # read more than once by the grouping that follows


def runs_for(recall: float, threshold: float, branch: int = 2) -> int:
    """The fewest runs that put a pair at ``threshold`` in one small bucket with the chance ``recall``.

    A run loses a pair whose sketches agree in a share p of the entries with the chance q = (1 - p + pq) ** branch at
    most, however deep it splits; the runs share the sketches, so this is averaged over all p. Raises
    ``ValueError`` where no number of runs reaches it, as ``branch`` is too small for the threshold.
    """
    agree = np.arange(WIDTH + 1) / WIDTH
    chance = np.array([comb(WIDTH, k) * threshold**k * (1 - threshold) ** (WIDTH - k) for k in range(WIDTH + 1)])
    lost = np.zeros(WIDTH + 1)
    for _ in range(1000):
        lost = (1 - agree + agree * lost) ** branch
    for runs in range(1, 65):
        if chance @ lost**runs <= 1 - recall:
            return runs
    raise ValueError(f"recall {recall} at {threshold} is not reached by 64 runs of {branch} branches")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of 0/1 blocks."""
    if len(left) == len(right) == 1:
        return np.array([[len(np.intersect1d(left[0], right[0], assume_unique=True))]])
    tokens = np.concatenate([*left, *right])
    _, token, times = np.unique(tokens, return_inverse=True, return_counts=True)
    many = np.cumsum(times > 1) - 1  # tokens of one set only are in no intersection
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    keep = times[token] > 1
    token, owner = many[token[keep]], owner[keep]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)  # exact: a block holds far under 2^24 shingles of one set, or one set
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, columns):
        a, b = np.searchsorted(token, [low, low + columns])
        block = np.zeros((len(left) + len(right), columns), np.float32)
        block[owner[a:b], token[a:b] - low] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return out.astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by ``key``."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.asarray(batch.column("key"))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)] if len(keys) else []
        for low, high in zip(cuts, cuts[1:]):
            if waiting and waiting[0].column("key")[0].as_py() != keys[low]:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(low, high - low))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per set and shingle, about ``PIECE`` * 16 rows or one set at a time."""
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
        ends = np.cumsum([len(x) for x in sets])
        at = 0
        while at < len(sets):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 16 * PIECE, "right")))
            each = np.repeat(np.arange(at, end), [len(x) for x in sets[at:end]])
            columns = [batch.column("blob").take(each), batch.column("set_id").take(each), pa.array(np.concatenate(sets[at:end]))]
            yield pa.RecordBatch.from_arrays(columns, names=["blob", "set_id", "token"])
            at = end


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of tokens as bytes."""
    for batch in batches:
        lists = batch.column("tokens")
        flat, ends = np.asarray(lists.values), np.asarray(lists.offsets)
        packed = pa.array([flat[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
        names = [n for n in batch.schema.names if n != "tokens"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), packed], names=[*names, "shingles"])


def _forms(large: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The forms that the sets of large groups take, and which set has which form.

    A shingle that one set of its group alone holds is in no intersection. Sets of one length that hold the same other
    shingles are of one form: they have the same similarity to any other set, and all or none of them are linked
    to each other (``own``). So a family of texts that differ in parts of their own is compared as one.
    """
    tokens = large.select("blob", "set_id", "shingles").mapInArrow(_tokens, "blob long, set_id long, token long")
    common = sized(tokens.groupBy("blob", "token").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    held = tokens.join(common, ["blob", "token"]).groupBy("set_id").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    described = sized(
        large.drop("shingles", "blocks")
        .join(held, "set_id")
        .withColumn("h1", F.xxhash64("tokens"))
        .withColumn("h2", F.xxhash64(F.lit(1), "tokens"))
    )
    key = ["blob", "n_shingles", "h1", "h2"]
    forms = sized(described.groupBy(*key).agg(F.min("set_id").alias("form"), F.sum("copies").alias("all_copies")))
    members = described.drop("tokens").join(forms, key).select("set_id", "form", "copies", "all_copies")
    heads = described.join(forms.select(F.col("form").alias("set_id"), "all_copies"), "set_id")
    size = F.size("tokens")
    own = size >= threshold * (2 * F.col("n_shingles") - size) - 1e-9
    heads = heads.select("blob", "set_id", F.col("all_copies").alias("copies"), "n_shingles", own.alias("own"), "tokens")
    packed = heads.mapInArrow(_packed, "blob long, set_id long, copies long, n_shingles int, own boolean, shingles binary")
    return sized(packed), members


def _blocks(shingles: int, sets: int):
    """In how many blocks the sets of a group are compared."""
    return F.greatest(F.ceil(F.sum(F.octet_length("shingles") / 8) / shingles), F.ceil(F.count("*") / sets)).cast("int").alias("blocks")


def _pairs_of_blocks(sets: DataFrame, whole: bool) -> DataFrame:
    """Each set of a group of B blocks once for every pair of blocks that its own is in; ``whole`` if one block holds the group."""
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    low, high = F.least("block", "other"), F.greatest("block", "other")
    both = sets.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    return both.select(F.xxhash64("blob", low, high).alias("key"), "set_id", "copies", "n_shingles", "shingles", side.alias("side"), F.lit(whole).alias("whole"))


def _verified(threshold: float):
    """Exact similarities inside each key: per set its linked rows and the least set it is tied to, directly or through others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            group = group.sort_by("set_id")
            ids, side, copies, long = (group.column(c).to_numpy() for c in ("set_id", "side", "copies", "n_shingles"))
            sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            left = np.flatnonzero(side <= 1)
            right = left if (side == 0).any() else np.flatnonzero(side == 2)
            if not len(left) or not len(right):
                continue
            shared = shared_counts([sets[i] for i in left], [sets[i] for i in right])
            either = long[left][:, None] + long[right][None, :] - shared
            link = shared >= threshold * either - 1e-9
            if right is left:
                np.fill_diagonal(link, False)
            links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
            links[left] += link @ copies[right]
            if right is not left:
                links[right] += copies[left] @ link
            changed = True
            while changed:  # least linked set, repeated until it holds for the whole chain
                old = root.copy()
                far = len(ids)
                np.minimum.at(root, left, np.where(link, root[right][None, :], far).min(axis=1))
                np.minimum.at(root, right, np.where(link, root[left][:, None], far).min(axis=0))
                root = root[root]
                changed = (old != root).any()
            some = links > 0
            if some.any():
                columns = [pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some]), pa.array(group.column("whole").to_numpy()[some])]
                yield pa.RecordBatch.from_arrays(columns, names=["set_id", "root", "links", "whole"])

    return run


def jaccard_join(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = 0.8,
    shingle: int = 5,
    runs: int | None = None,
    branch: int = 2,
    bucket_limit: int = 32,
    block_shingles: int = 200_000,
    recall: float = 0.99999,
    block_sets: int = 1024,
) -> DataFrame:
    """Links between texts whose sets of word shingles have Jaccard similarity ``threshold`` or more.

    Chosen-path join (Christiani, Pagh and Sivertsen, 2018): each set is embedded in a sketch of
    128 min-hashes; the sets are split by the values of two sampled entries, large buckets are
    split again, and small buckets are compared by sketch. A bucket that no longer shrinks is
    taken as alike as a whole. A pair at 0.8 whose sketches agree in 0.8 of the entries misses one run with a
    chance of 0.07 at most, at any depth. There are as many runs as ``recall`` needs (``runs_for``; ``runs`` sets another number): five
    for the default, which miss about 7 in 10^6, and fewer of more similar pairs; comparing sketches of small buckets, with ``SLACK``, adds about one in 10^12. This holds for
    sets of any size. The candidates only say which sets are compared:
    sets tied by them, directly or through others, are compared exactly, each pair once, in
    blocks of about ``block_shingles`` shingles and ``block_sets`` sets at most, which bounds a task's memory. In a group of more than
    a block, sets that differ only in shingles of their own are compared as one (``_forms``), so that a family of
    texts with a common frame costs its size, not its square. No pairs are written: each block gives counts and one tie per set.

    Returns ``key``, ``set_id`` (equal for equal shingle sets), ``n_shingles``, ``n_links`` (other
    rows linked to this one, copies counted) and ``class_id``, the least ``key`` of all rows tied
    by links. Equal sets are joined once and counted. Words are runs of other characters than
    space and 0x09-0x0D, A-Z lower-cased. A text of 1 to 4 words has one shingle, all its words;
    a null, empty or blank text has none, no links, and is its own class (``set_id`` 0). Rows with
    a null key are linked like others; a class of null keys only has a null ``class_id``. Repeated
    rows are rows of their own. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    described = sized(rows.mapInArrow(_described(shingle), _ROW))
    some = described.where("n_shingles > 0")
    # The row that stands for a set: the least key, then the least hash of the text.
    head = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "text_hash")).alias("head")
    name, sets = _bucketed(
        some.groupBy("set_id")
        .agg(head, F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n_shingles", "low", "high")])
        .select("set_id", "copies", "n_shingles", "low", "high", F.col("head.doc").alias("doc"), F.col("head.text_hash").alias("text_hash")),
        "set_id",
    )
    edges = _candidates(sets, runs or runs_for(recall, threshold, branch), branch, bucket_limit, threshold - SLACK)
    blobs = sized(
        linked_groups(edges, "a", "b")
        .withColumnsRenamed({"entity": "set_id", "group_id": "blob"})
        .join(sets.select("set_id", "copies", "n_shingles", "doc", "text_hash"), "set_id")
    )
    wanted = blobs.select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("set_id").alias("wanted"))
    # Merged at every size: broadcasting the few wanted rows of a small input would only hide what a large one moves.
    texts = rows.join(wanted.hint("merge"), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
    shingles = (
        texts.select("text", "wanted")
        .mapInArrow(_whole_sets(shingle), "set_id long, shingles binary")
        .groupBy("set_id")
        .agg(F.first("shingles").alias("shingles"))
    )
    whole = sized(blobs.select("set_id", "blob", "copies", "n_shingles").join(shingles, "set_id"))
    cut = _blocks(block_shingles, block_sets)
    blocks = sized(whole.groupBy("blob").agg(cut))
    compared = _pairs_of_blocks(whole.join(blocks.where("blocks = 1"), "blob"), True)
    cut_up = blocks.where("blocks > 1")
    some_cut = not cut_up.isEmpty()
    if some_cut:
        forms, members = _forms(whole.join(cut_up, "blob"), threshold)
        compared = compared.unionByName(_pairs_of_blocks(forms.join(sized(forms.groupBy("blob").agg(cut)), "blob"), False))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = sized(
        compared.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_verified(threshold), "set_id long, root long, links long, whole boolean")
    )
    # A group that one block held is tied already.
    tied = found.where("whole").select("set_id", F.col("root").alias("group"))
    verified = found.select("set_id", "root", "links")
    if some_cut:
        # What holds for a form holds for each of its sets; sets of one form are tied if linked to each other or to another set.
        across = found.where("not whole").select("set_id", "root", "links")
        outer = across.groupBy(F.col("set_id").alias("form")).agg(F.sum("links").alias("outer"))
        own = F.when(F.col("own"), F.col("all_copies") - F.col("copies")).otherwise(0)
        each = sized(
            members.join(forms.select(F.col("set_id").alias("form"), "own"), "form")
            .join(outer, "form", "left")
            .select("set_id", F.col("form").alias("root"), F.when(F.col("set_id") == F.col("form"), own).otherwise(own + F.coalesce("outer", F.lit(0))).cast("long").alias("links"))
            .where("links > 0")
        )
        tied = tied.unionByName(linked_groups(across.unionByName(each), "set_id", "root").withColumnsRenamed({"entity": "set_id", "group_id": "group"}))
        verified = verified.unionByName(each)
    links = verified.groupBy("set_id").agg(F.sum("links").alias("links"))
    known = sets.select("set_id", "copies", "doc").join(links, "set_id", "left").join(tied, "set_id", "left")
    known = sized(known.withColumn("group", F.coalesce("group", "set_id")))
    least = sized(known.groupBy("group").agg(F.min("doc").alias("class_id")))
    known = sized(
        known.join(least, "group").select(
            F.col("set_id").alias("_set"), F.col("group").alias("group_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "class_id"
        )
    )
    docs.sparkSession.sql(f"DROP TABLE {name}")  # its files stay in the shared folder, as other written tables do
    joined = described.select("doc", "text_hash", "set_id", "n_shingles").join(known, (F.col("set_id") == F.col("_set")) & (F.col("n_shingles") > 0), "left")
    none = F.col("n_shingles") == 0
    return joined.select(
        F.col("doc").alias(key),
        "set_id",
        F.col("n_shingles").cast("long").alias("n_shingles"),
        F.when(none, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(none, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        "group_id",
        "text_hash",
    )
