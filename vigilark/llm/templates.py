"""Benchmark passages in documents, also with other numbers, names and units, by canonical templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.llm.hashing import _BASE, _PLACE, hash_spans, mix, powers, slices, text_buffer
from vigilark.plans.rounds import sized

# Units that count as such after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t oz lb lbs gram grams kilogram kilograms ton tons tonnes ounce ounces pound pounds ml cl l liter liters litre litres gallon "
    "gallons s ms min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars "
    "euro euros cent cents usd eur degree degrees mph kph watt watts volt volts kw kwh"
).split()
NUMBER, NAME, UNIT = np.uint64(101), np.uint64(102), np.uint64(103)
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
CORE = DIGIT.copy()
CORE[65:91] = CORE[97:123] = CORE[128:] = True
BREAK = np.zeros(256, bool)
BREAK[[10, 33, 46, 58, 59, 63]] = True
BLOOM_BITS = 1 << 22


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    space = np.flatnonzero(raw == 32)
    return np.sort(hash_spans(raw, np.r_[0, space + 1], np.r_[space, len(raw)]))


def canonical(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of a text column: the template token, the value if it fills a slot (else 0), and the row.

    A token is a run of letters, digits and bytes beyond ASCII; a point or comma between digits
    belongs to the number. Digits alone are a number, a unit is one of ``UNITS`` after a number, and a name is a word with a
    capital that does not begin a sentence or the text. Other tokens stand for themselves, A-Z lower-cased.
    """
    raw, bounds = text_buffer(column)
    core = CORE[raw]
    if len(raw) > 2:
        digit = DIGIT[raw]
        core[1:-1] |= ((raw[1:-1] == 46) | (raw[1:-1] == 44)) & digit[:-2] & digit[2:]
    first = np.zeros(len(raw) + 1, bool)
    first[bounds] = True
    before = np.r_[False, core[:-1]][: len(raw)]
    after = np.r_[core[1:], False][: len(raw)]
    starts = np.flatnonzero(core & (~before | first[:-1]))
    ends = np.flatnonzero(core & (~after | first[1:])) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.searchsorted(bounds, starts, "right") - 1
    token = hash_spans(raw, starts, ends)
    letters = np.r_[0, np.cumsum(~DIGIT[raw] & CORE[raw])]
    number = letters[ends] == letters[starts]
    breaks = np.r_[0, np.cumsum(BREAK[raw])]
    opening = np.ones(len(starts), bool)
    opening[1:] = (row[1:] != row[:-1]) | (breaks[starts[1:]] > breaks[ends[:-1]])
    head, second = raw[starts], raw[np.minimum(starts + 1, len(raw) - 1)]
    capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    after_number = np.r_[False, number[:-1] & (row[1:] == row[:-1])]
    unit = after_number & np.isin(token, _unit_hashes())
    name = capital & ~opening & ~number & ~unit
    slot = np.where(number | name | unit, token, np.uint64(0))
    token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, token)))
    return token, slot, row


def _as_is(token: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Tokens as they stand, lower-cased; unlike any template's."""
    return np.where(slot != 0, slot, token) ^ np.uint64(0x5A5A5A5A)


def _windows(size: int, literal: int, bloom: np.ndarray | None):
    """Windows of the template (form 0) with ``literal`` tokens or more outside slots, and of the tokens as they stand (form 1).

    Only those that ``bloom`` may hold, if it is given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            token, slot, row = canonical(part.column("text"))
            n = len(token) - size + 1
            places = np.flatnonzero(row[:n] == row[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
            plain = np.r_[0, np.cumsum(slot == 0)]
            head = np.searchsorted(row, np.arange(part.num_rows))
            for form in (0, 1):
                at = places[plain[places + size] - plain[places] >= literal] if form == 0 else places
                tokens = token if form == 0 else _as_is(token, slot)
                value = np.zeros(len(at), np.uint64)
                for k in range(size):
                    value += tokens[at + k] * _PLACE[k]
                value = mix(value)
                if bloom is not None:
                    bit = value & np.uint64(BLOOM_BITS - 1)
                    hit = (bloom[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                    at, value = at[hit], value[hit]
                owner = row[at]
                width = size if form == 0 else 0
                slots = slot[at[:, None] + np.arange(width)[None, :]].view(np.int64).ravel() if width and len(at) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(owner)),
                        part.column("text_hash").take(pa.array(owner)),
                        pa.array((at - head[owner]).astype(np.int64)),
                        pa.array(value.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * width).astype(np.int32)), pa.array(slots)),
                        pa.array(np.full(len(at), form, np.int32)),
                    ],
                    names=["id", "text_hash", "at", "window", "slots", "form"],
                )

    return run


def _runs_of(token: np.ndarray, long: int) -> np.ndarray:
    """A hash of the ``long`` tokens from each place on, for any ``long``."""
    n = len(token)
    total = np.r_[np.uint64(0), np.cumsum(token * powers(n)[:n])]
    back = np.full(max(n, 1), pow(int(_BASE), -1, 1 << 64), np.uint64)
    back[0] = 1
    return mix((total[long:] - total[:-long]) * np.multiply.accumulate(back)[: n - long + 1] + np.uint64(long))


def _whole_items(literal: int, fewest: int, kinds: list[tuple[int, bool]] | None = None, bloom: np.ndarray | None = None):
    """Of benchmark items of ``fewest`` tokens or more one window of all tokens as they stand and, with ``literal`` tokens outside slots, one of the template.

    With ``kinds``, the windows of those lengths that ``bloom`` may hold, of all places of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            token, slot, row = canonical(part.column("text"))
            as_is = _as_is(token, slot)
            plain = np.r_[0, np.cumsum(slot == 0)]
            head = np.searchsorted(row, np.arange(part.num_rows))
            tokens = np.bincount(row, minlength=part.num_rows)
            for long, template in kinds if kinds is not None else [(int(x), t) for x in np.unique(tokens) if x >= fewest for t in (False, True)]:
                if long > len(token):
                    continue
                value = _runs_of(token if template else as_is, long)
                if kinds is None:
                    at = head[tokens == long]
                else:
                    at = np.flatnonzero(row[: len(value)] == row[long - 1 :])
                    bit = value[at] & np.uint64(BLOOM_BITS - 1)
                    at = at[(bloom[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
                if template:
                    at = at[plain[at + long] - plain[at] >= literal]
                owner = row[at]
                width = long if template else 0
                slots = slot[at[:, None] + np.arange(width)[None, :]].view(np.int64).ravel() if width and len(at) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(owner)),
                        part.column("text_hash").take(pa.array(owner)),
                        pa.array((at - head[owner]).astype(np.int64)),
                        pa.array(value[at].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * width).astype(np.int32)), pa.array(slots)),
                        pa.array(np.full(len(at), long, np.int64)),
                        pa.array(np.full(len(at), template)),
                    ],
                    names=["id", "text_hash", "at", "window", "slots", "long", "template"],
                )

    return run


def _hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))


def _template_rows(df: DataFrame, key: str, text: str, size: int, literal: int, bloom: np.ndarray | None = None) -> DataFrame:
    kind = dict(df.dtypes)[key]
    return _hashed(df, key, text).mapInArrow(_windows(size, literal, bloom), f"id {kind}, text_hash long, at long, window long, slots array<long>, form int")


def _whole_rows(df: DataFrame, key: str, text: str, literal: int, fewest: int, kinds: list[tuple[int, bool]] | None = None, bloom: np.ndarray | None = None) -> DataFrame:
    schema = f"id {dict(df.dtypes)[key]}, text_hash long, at long, window long, slots array<long>, long long, template boolean"
    return _hashed(df, key, text).mapInArrow(_whole_items(literal, fewest, kinds, bloom), schema)


def template_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    item: str = "item_id",
    text: str = "text",
    size: int = 8,
    literal: int = 4,
    least: float = 0.5,
    consistent: float = 0.8,
    fewest: int = 3,
) -> DataFrame:
    """Documents that hold ``least`` or more of the template windows of a benchmark item, with consistent slots.

    Both sides are made into templates: numbers, names and units become typed placeholders. Windows of ``size`` tokens, ``literal`` of
    them outside placeholders, are joined by hash. Slots are consistent if a value of the item stands for the same value of the
    document wherever it occurs; ``consistent`` is the share of the item's values for which this must hold. A Bloom filter
    of fixed size (0.5 MB) over the benchmark's windows thins the documents' windows before the shuffle;
    the join decides. Documents without a match are not returned.

    Every occurrence is judged by itself, and a document matches if any is covered and consistent. Windows are of one occurrence if
    their place in the document less that in the item is the same, or lies in the same range of 2 ``size`` (of two sets of ranges, so that
    a shift of up to ``size`` always lies in one); the whole document is judged as well. The best accepted occurrence is returned.
    Windows of the tokens as they stand, whatever their case, are a second form of an item: a copy in capitals, where each word looks like a name,
    is covered by these, and nothing is asked of its slots. A match is the better of the two forms.
    An item without template windows (short, or with few literals) is one window: all its tokens as they stand, whatever their case and without a
    slot check, or all its template if that has ``literal`` tokens outside placeholders. Documents are hashed once for each length of such items.
    An item of under ``fewest`` tokens ("Yes", "42") is in every other text and is not looked for; ``not_checkable`` lists such items.

    Returns ``key``, text_hash (``xxhash64`` of the text), ``item``, n_windows (distinct windows of the item that were found), item_windows,
    coverage, n_slots (distinct slot values matched), n_consistent and exact (every slot holds the item's own value). Null and
    empty texts never match. Null keys are results like others. Equal rows (same key and
    text) give one result; repeated items one each by their key, equal keys with other texts being items of their own. Other columns are ignored.
    """
    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    usual = sized(_template_rows(benchmark, item, text, size, literal).distinct())
    whole = _whole_rows(benchmark, item, text, literal, fewest).distinct()
    templates = usual.where("form = 0").select("id", "text_hash")
    whole = sized(whole.join(templates, same(whole, templates, ["id", "text_hash"]), "left_anti").withColumn("form", F.lit(0)))
    kinds = sorted((r["long"], r["template"]) for r in whole.select("long", "template").distinct().collect())
    windows = usual.unionByName(whole.drop("long", "template"))  # a short item has no windows as it stands but the whole one
    bit = F.col("window").bitwiseAND(BLOOM_BITS - 1)
    words = windows.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(window & 63 as int))")).alias("bits")).collect()
    bloom = np.zeros(BLOOM_BITS // 64, np.uint64)
    bloom[[r["w"] for r in words]] = np.array([r["bits"] for r in words], np.int64).view(np.uint64)
    found = _template_rows(docs, key, text, size, literal, bloom)
    if kinds:
        found = found.unionByName(_whole_rows(docs, key, text, literal, fewest, kinds, bloom).drop("long", "template").withColumn("form", F.lit(0)))
    its = windows.select(F.col("id").alias("_item"), F.col("text_hash").alias("_item_hash"), F.col("at").alias("_at"), "window", "form", F.col("slots").alias("_slots"))
    both = found.join(its, ["window", "form"]).select(
        "id", "text_hash", "_item", "_item_hash", "form", "_at", (F.col("at") - F.col("_at")).alias("place"), F.filter(F.arrays_zip("_slots", "slots"), lambda x: x["_slots"] != 0).alias("pairs")
    )
    match = ["id", "text_hash", "_item", "_item_hash"]
    each = [*match, "form"]
    by = [*each, "level", "part"]
    place, wide = F.col("place"), 2 * size
    parts = [F.lit(0).cast("long"), place, F.floor(place / wide), F.floor((place + size) / wide)]
    occurrence = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), x.cast("long").alias("part")) for k, x in enumerate(parts)])).alias("o")
    both = sized(both).select(*each, "_at", "pairs", occurrence).select(*each, "o.level", "o.part", "_at", "pairs")
    covered = both.groupBy(*by, "_at").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count("*").alias("n_windows"))
    values = both.select(*by, F.explode("pairs").alias("p")).select(*by, F.col("p._slots").alias("a"), F.col("p.slots").alias("b"))
    values = values.distinct().groupBy(*by, "a").agg(F.count("*").alias("n"), F.min(F.col("a") == F.col("b")).alias("same"))
    values = values.groupBy(*by).agg(F.count("*").alias("n_slots"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("n_consistent"), F.min(F.col("same") & (F.col("n") == 1)).alias("exact"))
    total = windows.groupBy(F.col("id").alias("_item"), F.col("text_hash").alias("_item_hash"), "form").agg(F.countDistinct("at").alias("item_windows"))
    first = covered.alias("c").join(total.alias("t"), same(covered, total, ["_item", "_item_hash", "form"])).select(*[covered[c] for c in by], "n_windows", "item_windows")
    out = first.join(values, same(first, values, by), "left").select(
        *[first[c] for c in by], "n_windows", "item_windows", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_slots", "n_consistent")], F.coalesce("exact", F.lit(True)).alias("exact")
    )
    coverage = F.col("n_windows") / F.col("item_windows")
    accepted = out.where((coverage >= least) & (F.col("n_consistent") >= consistent * F.col("n_slots")))
    best = accepted.groupBy(*match).agg(F.max(F.struct("exact", coverage.alias("_coverage"), "n_windows", "n_consistent", (-F.col("n_slots")).alias("_fewest"), "n_slots", "item_windows")).alias("best")).select(*match, "best.*")
    return best.select(
        F.col("id").alias(key), "text_hash", F.col("_item").alias(item), "n_windows", "item_windows", coverage.alias("coverage"), "n_slots", "n_consistent", "exact"
    )


def not_checkable(benchmark: DataFrame, item: str = "item_id", text: str = "text", fewest: int = 3) -> DataFrame:
    """The items (``item``, ``text``) of under ``fewest`` tokens, none included: ``template_matches`` does not look for them."""
    tokens = _hashed(benchmark, item, text).mapInArrow(_token_counts, f"id {dict(benchmark.dtypes)[item]}, text string, n long")
    return tokens.where(F.col("n") < fewest).select(F.col("id").alias(item), F.col("text").alias(text))


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 1 << 20):
        counts = np.bincount(canonical(part.column("text"))[2], minlength=part.num_rows)
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text"), pa.array(counts.astype(np.int64))], names=["id", "text", "n"])
