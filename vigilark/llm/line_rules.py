"""Line-first cleaning: rules per line, then a verdict per document. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
# How a line of prose may end, what parts menus, and phrases of page furniture.
ENDS = list(".!?…。！？")
CLOSERS = "\"'”’»)]"
PARTS = "|»›·"
MENU = r"^(home|menu|login|log in|sign in|sign up|subscribe|next page|previous page|read more|click here|share this|back to top|skip to content)\b"
FURNITURE = [
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie", "enable javascript",
    "lorem ipsum", "copyright", "©", "licensed under", "licenced under", "powered by", "{",
]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def _without(text: Column, characters: str) -> Column:
    """``text`` less the given characters; replacing one by one searches bytes, far faster than translating."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def _covered(found: Column, size: int) -> Column:
    """How many words lie in windows found twice or more, from the array of all windows."""
    placed = F.sort_array(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
        return F.filter(s, lambda x, k: same(x, k + 1) | ((k > 0) & same(x, k - 1)))

    starts = let(placed, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
    step = lambda acc, p: F.struct(
        (acc["n"] + p + size - F.greatest(p, acc["end"])).cast("long").alias("n"), (p + size).cast("long").alias("end")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words in windows of ``size`` that occur twice or more in the text, the first included."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    window = lambda i: [F.get(words, i + k) for k in range(size)]
    # Windows without two equal hashes are all different; only other texts need them compared as they are.
    hashed = F.transform(places, lambda i: F.xxhash64(*window(i)))
    many = let(hashed, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    whole = F.transform(places, lambda i: F.concat_ws(" ", *window(i)))
    return F.when(many, _covered(whole, size)).otherwise(F.lit(0).cast("long"))


def line_fails(line: Column) -> Column:
    """Whether a trimmed line with a word fails the rules of punctuation, navigation or boilerplate."""
    n = F.length(line)
    count = lambda characters: n - F.length(_without(line, characters))
    end = F.substring(F.rtrim(line, F.lit(CLOSERS)), -1, 1)
    punctuation = ~end.isin(ENDS) | (60 * count(SYMBOLS) > n) | (20 * count("!") > F.greatest(n, F.lit(24)))
    phrase = lambda low: low.rlike(MENU) | reduce(or_, [F.contains(low, F.lit(x)) for x in FURNITURE])
    return punctuation | (24 * count(PARTS) > n) | let(F.lower(line), phrase)


def clean_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", max_lost: float = 0.5, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Counts, the cleaned text and the verdict of every row.

    Lines are judged first: a line fails that does not end like a sentence, holds a symbol of
    ``#*$%&|<>`` in 60 characters or an exclamation mark in 20, is parted like a menu (a bar or
    dot in 24), or holds a phrase of page furniture. ``clean_text`` is the text less those lines. A document
    is kept unless it has under 10 words, more than a fifth of its words lie in repeated 5-word
    windows (``base_failed``), or its failing lines hold more than ``max_lost`` of the characters of
    its lines with words.

    Returns ``key``, the columns ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines (lines with a word), n_failed_lines, lost_chars, line_chars, base_failed, kept and clean_text. A null
    text counts as empty: all counts 0, base_failed, clean_text ``""``. Null keys and repeated rows stay as
    they are; other columns are ignored. Each row is judged by itself: nothing is shuffled.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = lambda line: F.btrim(line, F.lit(SPACES))
    own = docs.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_keep_{c}") for c in keep], whole.alias("_text"))
    own = own.withColumn(
        "_lines",
        F.transform(
            F.split("_text", "\n"),
            lambda line: let(
                trimmed(line),
                lambda t: F.struct(
                    line.alias("line"), F.length(t).alias("n"), (t != "").alias("full"), ((t != "") & line_fails(t)).alias("failed")
                ),
            ),
        ),
    )
    full = F.filter("_lines", lambda x: x["full"])
    total = lambda test: F.aggregate("_lines", F.lit(0).cast("long"), lambda a, x: a + F.when(test(x), x["n"]).otherwise(0).cast("long"))
    n = F.col("n_words")
    return (
        own.select(
            "_key",
            *[f"_keep_{c}" for c in keep],
            let(
                words_of(F.col("_text")),
                lambda w: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    repeated_words(w).alias("n_repeat_words"),
                ),
            ).alias("_words"),
            (F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
            let(full, lambda f: (F.size(f) - F.size(F.array_distinct(F.transform(f, lambda x: x["line"]))))).cast("long").alias("n_dup_lines"),
            F.size(full).cast("long").alias("n_lines"),
            F.size(F.filter("_lines", lambda x: x["failed"])).cast("long").alias("n_failed_lines"),
            total(lambda x: x["failed"]).alias("lost_chars"),
            total(lambda x: x["full"]).alias("line_chars"),
            F.array_join(F.transform(F.filter("_lines", lambda x: ~x["failed"]), lambda x: x["line"]), "\n").alias("clean_text"),
        )
        .select("*", "_words.*")
        .withColumn("base_failed", (n < 10) | (100 * F.col("n_repeat_words") > 20 * n))
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= max_lost * F.col("line_chars")))
        .select(
            F.col("_key").alias(key),
            *[F.col(f"_keep_{c}").alias(c) for c in keep],
            *"n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_failed_lines lost_chars line_chars base_failed kept clean_text".split(),
        )
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, [x FOR x IN string_split_regex(text, '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM d),
win AS (
  SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)),
rep AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS p FROM rep WHERE n > 1) GROUP BY r),
l AS (SELECT r, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
c AS (SELECT r, line, t, length(t) AS n, lower(t) AS low FROM l WHERE t <> ''),
f AS (
  SELECT r, line, length(t) AS n,
    NOT regexp_matches(t, '[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}]["''\x{201D}\x{2019}\x{00BB})\]]*$')
    OR 60 * (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) > n
    OR 20 * (length(t) - length(replace(t, '!', ''))) > greatest(n, 24)
    OR 24 * (length(t) - length(regexp_replace(t, '[|\x{00BB}\x{203A}\x{00B7}]', '', 'g'))) > n
    OR regexp_matches(low, '^(home|menu|login|log in|sign in|sign up|subscribe|next page|previous page|read more|click here|share this|back to top|skip to content)\b')
    OR regexp_matches(low, 'all rights reserved|privacy policy|terms of (use|service)|cookie|enable javascript|lorem ipsum|copyright|\x{00A9}|licen[sc]ed under|powered by|\{') AS failed
  FROM c),
g AS (
  SELECT r, count(*) - count(DISTINCT line) AS dup, count(*) AS n_lines, count(*) FILTER (failed) AS n_failed,
         coalesce(sum(n) FILTER (failed), 0)::BIGINT AS lost, sum(n)::BIGINT AS chars
  FROM f GROUP BY r),
o AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_failed, 0)::BIGINT AS n_failed_lines,
    coalesce(lost, 0)::BIGINT AS lost_chars, coalesce(chars, 0)::BIGINT AS line_chars
  FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN g USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars <= 0.5 * line_chars AS kept
FROM o
"""
