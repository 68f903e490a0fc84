"""Queries on documents, pages, vectors and threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.operators import neighbours, profiles, texts, threads, vectors
from vigilark.registry import query
from vigilark.sources.tables import table

VECTOR_LENGTH = 64

# A sample dictionary of (term, tag, weight) for the invented text.
DICTIONARY = [
    ("the", "first", 1.0),
    ("der", "first", 1.0),
    ("que", "first", 1.5),
    ("rest", "second", 2.0),
    ("tion", "second", 0.5),
    ("ment", "second", 0.5),
    ("ent", "third", 3.0),
    ("on", "third", 0.25),
    ("and", "third", 0.25),
]


@query(
    """
    SELECT source, lang, CAST(count(*) AS BIGINT) AS n_items, CAST(sum(n_chars) AS BIGINT) AS total_size
    FROM documents GROUP BY GROUPING SETS ((source), (lang), ())
    """
)
def volume_by_source(spark: SparkSession, d: str) -> DataFrame:
    """P18 re-aimed: how much each source and language delivers."""
    return profiles.volume_by_source(table(spark, d, "documents"), "source", "lang", "n_chars")


@query(
    """
    WITH words AS (
        SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS term FROM documents
    ), dictionary(term, tag, weight) AS (VALUES """
    + ", ".join(f"('{t}', '{g}', {w}::DOUBLE)" for t, g, w in DICTIONARY)
    + """)
    SELECT doc_id, tag, CAST(count(*) AS BIGINT) AS n_hits, sum(weight) AS score
    FROM words JOIN dictionary USING (term) GROUP BY doc_id, tag
    """
)
def dictionary_tags(spark: SparkSession, d: str) -> DataFrame:
    """P22."""
    dictionary = spark.createDataFrame(DICTIONARY, "term string, tag string, weight double")
    return texts.dictionary_tags(table(spark, d, "documents"), "doc_id", "text", dictionary)


@query(
    """
    WITH words AS (
        SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS term FROM documents
    ), tf AS (
        SELECT doc_id, term, count(*) AS n FROM words WHERE term <> '' GROUP BY ALL
    ), df AS (
        SELECT term, count(*) AS df FROM tf GROUP BY term
    ), scored AS (
        SELECT doc_id, term, n, n * ln(((SELECT count(*) FROM documents) + 1) / CAST(df + 1 AS DOUBLE)) AS tf_idf
        FROM tf JOIN df USING (term)
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf_idf, 9) DESC, term) AS position FROM scored
    )
    SELECT doc_id, term, CAST(n AS BIGINT) AS n, round(tf_idf, 6) AS tf_idf, CAST(position AS BIGINT) AS position
    FROM ranked WHERE position <= 5
    """
)
def tf_idf_terms(spark: SparkSession, d: str) -> DataFrame:
    """P23."""
    top = texts.tf_idf_terms(table(spark, d, "documents"), "doc_id", "text", 5)
    return top.withColumn("tf_idf", F.round("tf_idf", 6))


@query(
    """
    WITH p AS (
        SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
               CAST(url LIKE '%?%' AS BIGINT) AS q, CAST(url LIKE '%#%' AS BIGINT) AS f,
               len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '')) AS depth
        FROM pages
    )
    SELECT host, CAST(count(*) AS BIGINT) AS n_urls, CAST(sum(q) AS BIGINT) AS n_with_query,
           CAST(sum(f) AS BIGINT) AS n_with_fragment, CAST(max(depth) AS BIGINT) AS max_depth
    FROM p GROUP BY host
    """
)
def host_profile(spark: SparkSession, d: str) -> DataFrame:
    """P25 re-aimed: which hosts are watched, from the addresses."""
    return texts.host_profile(table(spark, d, "pages"), "url")


@query(
    """
    WITH e AS (
        SELECT label, unnest(range(len(embedding))) AS position, unnest(embedding) AS x FROM embeddings
    )
    SELECT CAST(label AS BIGINT) AS label, CAST(position AS BIGINT) AS position, round(avg(CAST(x AS DOUBLE)), 6) AS mean
    FROM e GROUP BY ALL
    """
)
def group_centroids(spark: SparkSession, d: str) -> DataFrame:
    """P30, one row per label and position."""
    centroids = vectors.group_centroids(table(spark, d, "embeddings"), ["label"], "embedding", VECTOR_LENGTH)
    return centroids.select(F.col("label").cast("bigint").alias("label"), F.posexplode("centroid").alias("position", "mean")).select(
        "label", F.col("position").cast("bigint").alias("position"), F.round("mean", 6).alias("mean")
    )


_SIMILARITY_SQL = """
    WITH e AS (
        SELECT label, unnest(range(len(embedding))) AS position, unnest(embedding) AS x FROM embeddings
    ), c AS (
        SELECT label, position, avg(CAST(x AS DOUBLE)) AS mean FROM e GROUP BY ALL
    ), centroid AS (
        SELECT label, list(mean ORDER BY position) AS centroid FROM c GROUP BY label
    ), scored AS (
        SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) AS similarity
        FROM embeddings JOIN centroid USING (label)
    )
"""


@query(
    _SIMILARITY_SQL
    + """
    , ranked AS (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(similarity, 9) DESC, vec_id) AS position FROM scored
    )
    SELECT vec_id, CAST(label AS BIGINT) AS label, round(similarity, 6) AS similarity, CAST(position AS BIGINT) AS position
    FROM ranked WHERE position <= 5
    """
)
def central_members(spark: SparkSession, d: str) -> DataFrame:
    """P28 re-aimed: the vectors most similar to the centre of their label."""
    top = vectors.central_members(table(spark, d, "embeddings"), "vec_id", ["label"], "embedding", VECTOR_LENGTH, 5)
    return top.withColumns({"label": F.col("label").cast("bigint"), "similarity": F.round("similarity", 6)})


@query(
    _SIMILARITY_SQL
    + """
    , d AS (
        SELECT vec_id, label, round(1 - similarity, 9) AS distance FROM scored
    ), b AS (
        SELECT label, round(quantile_cont(distance, 0.95), 9) AS bound FROM d GROUP BY label
    )
    SELECT vec_id, CAST(label AS BIGINT) AS label, round(distance, 6) AS distance, round(bound, 6) AS bound
    FROM d JOIN b USING (label) WHERE distance > bound
    """
)
def centroid_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Vectors unusually far from the centre of their label."""
    far = vectors.centroid_outliers(
        table(spark, d, "embeddings"), "vec_id", ["label"], "embedding", VECTOR_LENGTH, 0.95
    )
    return far.withColumns(
        {"label": F.col("label").cast("bigint"), "distance": F.round("distance", 6), "bound": F.round("bound", 6)}
    )


@query(
    """
    WITH c AS (
        SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations
    )
    SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, CAST(count(*) FILTER (WHERE role = previous) AS BIGINT) AS n_breaks,
           arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, CAST(sum(length(text)) AS BIGINT) AS n_chars
    FROM c GROUP BY conv_id
    """
)
def thread_summary(spark: SparkSession, d: str) -> DataFrame:
    """P31."""
    return threads.thread_summary(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query(
    """
    WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (
        SELECT q.vec_id, r.vec_id AS neighbour, round(list_cosine_similarity(q.e, r.e), 9) AS similarity
        FROM u q JOIN u r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
    )
    SELECT vec_id, neighbour, round(similarity, 6) AS similarity,
           row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS position
    FROM p QUALIFY position <= 10
    """
)
def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every fiftieth, exact."""
    found = neighbours.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", VECTOR_LENGTH, F.col("vec_id") % 50 == 0, 10)
    return found.withColumn("similarity", F.round("similarity", 6))


@query()
def vector_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of cosine 0.3 or more, up to ten for every fiftieth, by sign keys; recall is tested."""
    return neighbours.similar(table(spark, d, "embeddings"), "vec_id", "embedding", VECTOR_LENGTH, F.col("vec_id") % 50 == 0, 10, 0.3)


@query(
    """
    WITH t AS (
        SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY conv_id
    ), p AS (
        SELECT conv_id, whole, unnest(range(0, CAST(ceil(length(whole) / 1000.0) AS BIGINT))) AS part FROM t
    )
    SELECT conv_id, part, substring(whole, part * 1000 + 1, 1000) AS text FROM p
    """
)
def transcript_parts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written out in order, in parts of a thousand characters."""
    said = F.concat("role", F.lit(": "), "text")
    return threads.transcript_parts(table(spark, d, "conversations"), "conv_id", "turn", "role", said, 1000)
