"""Mixing sources to target weights: integer quotas of equal blocks, then a seeded choice of blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark.plans.keyed import join_null_safe
from vigilark.plans.rounds import sized

WORD = r"[^\x20\x09-\x0D]+"


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Rows with their place ``rank`` (from 0) in a total order, found by range and never in one task."""
    part = sized(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = part.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per task of the sort
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return part.join(offsets, "_part").withColumn("rank", F.col("_before") + inside).drop("_part", "_before")


def targets(sources: DataFrame, weights: Sequence[float], stop: float) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: shares by weight of all sizes, at most ``stop`` times a size.

    The k-th source by code point, null last, takes the k-th weight, which repeat. With the
    excess shared again until none is above its stop, every target is min(stop * size, level *
    weight) for one level, which rises from round to round; a round is one sum over the sources.
    """
    order = [F.col("source").asc_nulls_last()]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    out = sized(ranked(sources, *order).withColumn("weight", weight).drop("rank"))
    most = stop * F.col("source_size")
    level, closed = 0.0, -1
    while True:
        over = F.col("weight") * level > most
        x = out.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(over, most).otherwise(0.0)).alias("taken"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(F.when(over, 1).otherwise(0)).alias("closed"),
        ).first()
        if not x["all"] or x["closed"] == closed or not x["open"]:
            break
        level, closed = (x["all"] - x["taken"]) / x["open"], x["closed"]
    return out.withColumn("target", F.least(most.cast("double"), F.col("weight") * level))


def sainte_lague(df: DataFrame, groups: Sequence[str], order: Sequence[str], weight: str, seats: str, most: str) -> DataFrame:
    """``df`` with ``quota``: the ``seats`` of each group dealt to its rows by the highest quotients weight / (2k - 1).

    The divisor lies between two bounds, so that most seats follow at once and only two or three
    quotients per row are ranked. Ties go to the least ``order``. No row gets more than ``most``;
    what it cannot take stays undealt. Rows of no weight get 0.
    """
    keys = list(groups)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sums = [F.count("*").alias("_n"), F.sum(weight).alias("_sum"), F.max(seats).alias("_seats")]
    if keys:
        known = join_null_safe(df, df.groupBy(*keys).agg(*sums), keys)
    else:
        x = df.agg(*sums).first()
        known = df.withColumns({c: F.lit(x[c]) for c in ("_n", "_sum", "_seats")})
    at = lambda shift: F.floor(F.coalesce(F.try_divide(F.col(weight) * F.greatest(F.col("_seats") + shift, F.lit(0)), F.col("_sum")), F.lit(0)) + 0.5)
    capped = lambda c: F.least(c.cast("long"), F.col(most).cast("long"))
    known = sized(
        known.withColumn("_low", F.when(F.col(weight) > 0, capped(at(-F.col("_n") / 2))).otherwise(0))
        .withColumn("_high", F.when(F.col(weight) > 0, capped(at(F.col("_n") / 2))).otherwise(0))
    )
    open_seats = known.where("_high > _low").withColumn("_k", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    open_seats = open_seats.withColumn("_quotient", F.col(weight) / (2 * F.col("_k") - 1))
    by = [F.col("_quotient").desc(), *[F.col(c).asc_nulls_last() for c in order], F.col("_k")]
    if keys:
        rest = join_null_safe(open_seats, known.groupBy(*keys).agg(F.max("_seats").alias("_all"), F.sum("_low").alias("_given")), keys)
        won = rest.withColumn("_place", F.row_number().over(group.orderBy(*by))).where(F.col("_place") <= F.col("_all") - F.col("_given"))
    else:
        x = known.agg(F.coalesce(F.max("_seats") - F.sum("_low"), F.lit(0)).cast("int").alias("rest")).first()
        won = open_seats.orderBy(*by).limit(max(0, x["rest"]))
    more = won.groupBy(*keys, *order).agg(F.count("*").alias("_more"))
    named = list(dict.fromkeys([*keys, *order]))
    return (
        join_null_safe(known, more, named, "left")
        .withColumn("quota", F.col("_low") + F.coalesce("_more", F.lit(0)))
        .drop("_n", "_sum", "_seats", "_low", "_high", "_more")
    )


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    stop: float = 3,
    block_words: int = 64,
    few_blocks: int = 64,
    shard_words: int = 500_000,
    seed: int = 7,
    keep: Sequence[str] = (),
) -> DataFrame:
    """What a mix takes of every row.

    Rows are dealt by a seeded hash to shards of a source and laid on a line there; the line is cut
    into equal blocks of about ``block_words``; a source whose size or target is under ``few_blocks`` of these is dealt by
    single words, so that small sources get their share too. Sainte-Laguë quotients give the number of blocks
    for each source by its target, among the sources of equal blocks, then for each shard by its words. In a shard the
    quota is spread evenly over the blocks from a seeded start, so a block is taken at most
    ``stop`` times. A hot source has more shards, not larger ones.

    Returns ``key``, the columns ``keep``, size, source_size, target, taken (words taken,
    repeats counted) and ``spans``: arrays of (times, start, end) in words of the row, in order. A null or
    blank text has size 0 and nothing is taken; a null source is a source of its own. Repeated
    rows are rows of their own; equal keys and texts are laid by the columns ``keep``. Other columns are ignored. Reruns agree.
    """
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    place = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    base = docs.select(
        F.col(key).alias("_key"), F.col(source).alias("source"), size.alias("size"), place.alias("_place"), *[F.col(c).alias(f"_keep_{c}") for c in keep]
    )
    narrow = sized(base.select("_key", "source", "size", "_place"))
    found = sized(narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
    aims = sized(targets(found, weights, stop).withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))))
    with_shard = lambda df: join_null_safe(df, aims.drop("weight", "most"), ["source"]).withColumn("shard", F.pmod(F.col("_place"), F.col("shards")))
    small = F.least(F.col("source_size").cast("double"), F.col("target")) < few_blocks * block_words
    aims = aims.withColumn("unit", F.when(small, 1).otherwise(block_words))
    cells = with_shard(narrow).groupBy("source", "shard").agg(F.sum("size").alias("words"), F.max("target").alias("target"), F.max("unit").alias("unit"))
    blocks = F.when(F.col("words") > 0, F.greatest(F.round(F.col("words") / F.col("unit")).cast("long"), F.lit(1))).otherwise(0)
    cells = sized(cells.withColumn("blocks", blocks))
    per_source = sized(cells.groupBy("source").agg(F.max("target").alias("target"), (F.sum("blocks") * int(stop)).alias("most"), F.max("unit").alias("unit")))
    dealt = None
    for unit in (1, block_words):
        alike = per_source.where(F.col("unit") == unit)
        seats = alike.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("x")).first()["x"] / unit
        quotas = sainte_lague(alike.withColumn("seats", F.lit(round(seats))), [], ["source"], "target", "seats", "most")
        dealt = dealt.unionByName(quotas) if dealt else quotas
    cells = join_null_safe(cells.drop("target", "unit"), dealt.select("source", F.col("quota").alias("seats")), ["source"])
    cells = cells.withColumns({"most": F.col("blocks") * int(stop), "weight": F.col("words").cast("double")})
    cells = sized(sainte_lague(cells, ["source"], ["shard"], "weight", "seats", "most").select("source", "shard", "words", "blocks", "quota"))
    line = Window.partitionBy("source", "shard").orderBy("_place", "_key", *[f"_keep_{c}" for c in keep]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = with_shard(base if keep else narrow).drop("unit").withColumn("_end", F.sum("size").over(line)).withColumn("_start", F.col("_end") - F.col("size"))
    laid = join_null_safe(laid, cells, ["source", "shard"])
    n, c, q = F.col("blocks"), F.col("words"), F.col("quota")
    turn = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), n)
    laid = laid.withColumns({"_n": n, "_c": c, "_q": q, "_turn": F.when(n > 0, turn).otherwise(0)})
    spans = F.expr(
        """
        CASE WHEN size = 0 OR _q = 0 THEN CAST(array() AS ARRAY<STRUCT<times: BIGINT, start: BIGINT, end: BIGINT>>) ELSE
        filter(transform(
          sequence(((_start + 1) * _n - 1) DIV _c, (_end * _n - 1) DIV _c),
          b -> named_struct(
            'times', _q DIV _n + ((b + 1) * (_q % _n) + _turn) DIV _n - (b * (_q % _n) + _turn) DIV _n,
            'start', greatest((b * _c) DIV _n, _start) - _start,
            'end', least(((b + 1) * _c) DIV _n, _end) - _start)),
          x -> x.times > 0 AND x.end > x.start) END
        """
    )
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["times"] * (x["end"] - x["start"]))
    return laid.withColumn("spans", spans).select(
        F.col("_key").alias(key), *[F.col(f"_keep_{k}").alias(k) for k in keep], "size", "source_size", "target", taken.alias("taken"), "spans"
    )
