"""Terms in text columns, and parts of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.functions.text import words
from vigilark.operators.entities import top_k_per_group
from vigilark.plans.keyed import join_null_safe
from vigilark.plans.rounds import sized


def exploded_words(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(key, text)
    return rows.select(key, F.explode(words(F.col(text))).alias("term")).where("term <> ''")


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """How often each word occurs in each row's text."""
    return (
        exploded_words(df, key, text)
        .groupBy(key, "term")
        .agg(F.count("*").alias("n"))
    )


def dictionary_tags(df: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """Hits and weighted score per row and tag, for a dictionary of (term, tag, weight).

    Words meet the dictionary before anything is counted: Spark sends a small dictionary to the words and shuffles hits only;
    of a large one it shuffles both sides and splits a frequent word.
    """
    hits = exploded_words(df, key, text).join(dictionary, "term")
    return hits.groupBy(key, "tag").agg(F.count("*").alias("n_hits"), F.sum("weight").alias("score"))


def counted_in_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row its ``terms``, an array of (term, n): nothing is shuffled. Null where there is no word."""
    sorted_words = F.sort_array(F.filter(words(F.col(text)), lambda w: w != ""))
    rows = df.select(key, sorted_words.alias("_words"))
    first = lambda i: (i == 0) | (F.get("_words", i) != F.get("_words", i - 1))
    places = F.when(F.size("_words") > 0, F.sequence(F.lit(0), F.size("_words") - 1))
    starts = rows.select(key, "_words", F.filter(places, first).alias("_starts"))
    end = lambda i: F.coalesce(F.get("_starts", i + 1), F.size("_words"))
    run = lambda at, i: F.struct(F.get("_words", at).alias("term"), (end(i) - at).cast("long").alias("n"))
    return starts.select(key, F.transform("_starts", run).alias("terms"))


def tf_idf_terms(df: DataFrame, key: str, text: str, k: int, common: int = 50_000) -> DataFrame:
    """The ``k`` terms with the highest tf × ln((N + 1) / (df + 1)) per row; rows of one key are one text.

    Words are counted where the text lies; only texts whose key occurs again are counted over a shuffle. The ``common`` most frequent
    terms are sent to all tasks, so of their counts only ``k`` per text and task are shuffled; the counts of rarer terms are joined.
    """
    rows = df.select(key, text)
    again = sized(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    single = sized(counted_in_rows(join_null_safe(rows, again, [key], "left_anti"), key, text))
    merged = sized(term_counts(join_null_safe(rows, again, [key], "left_semi"), key, text))
    tf = single.select(key, F.inline("terms")).unionByName(merged)
    frequency = sized(tf.groupBy("term").agg(F.count("*").alias("df")))
    top = F.broadcast(sized(frequency.orderBy(F.col("df").desc(), "term").limit(common)))
    rare = tf.join(top, "term", "left_anti").join(frequency.join(top, "term", "left_anti"), "term")
    n_texts = df.agg(F.count("*")).scalar()
    scored = tf.join(top, "term").unionByName(rare).select(
        key,
        "term",
        "n",
        (F.col("n") * F.ln((n_texts + 1) / (F.col("df") + 1))).alias("tf_idf"),
    )
    return top_k_per_group(scored, [key], [F.round("tf_idf", 9).desc(), F.col("term")], k)


def host_profile(df: DataFrame, url: str) -> DataFrame:
    """Addresses per host: how many, with a query, with a fragment, and the deepest path."""
    part = lambda name: F.try_parse_url(F.col(url), F.lit(name))
    parsed = df.select(
        part("HOST").alias("host"),
        part("QUERY").isNotNull().cast("bigint").alias("q"),
        part("REF").isNotNull().cast("bigint").alias("f"),
        F.size(F.filter(F.split(part("PATH"), "/"), lambda s: s != "")).cast("bigint").alias("depth"),
    )
    return parsed.groupBy("host").agg(
        F.count("*").alias("n_urls"),
        F.sum("q").alias("n_with_query"),
        F.sum("f").alias("n_with_fragment"),
        F.max("depth").alias("max_depth"),
    )
