"""Registered queries of the operators for training data, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from vigilark.llm import additive, apportion, bytes_model, cross_parsing, html_blocks, jaccard_join, line_rules, line_runs, manifest, packing, repair, separators, templates
from vigilark.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


@query()
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


@query(line_rules.SQL)
def op1_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")


@query()
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apportion.mix(table(spark, sf_dir, "documents")).drop("spans")


@query()
def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(table(spark, sf_dir, "documents"))


@query()
def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.withColumns({"ids_hash": F.xxhash64("input_ids"), "positions_hash": F.xxhash64("position_ids")}).drop("input_ids", "position_ids")


@query()
def op9_template_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.schema("item_id bigint, text string").parquet(f"{sf_dir}/benchmark.parquet")
    return templates.template_matches(table(spark, sf_dir, "documents"), benchmark)


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def _fold(key: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % parts


@query()
def op3_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytes_model.ppm_scores(table(spark, sf_dir, "documents"), _fold("doc_id", 5) == 1)


@query()
def op5_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parsing.languages(table(spark, sf_dir, "documents"), _fold("doc_id", 4) == 2)


@query()
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_texts(table(spark, sf_dir, "pages"))


@query()
def op7_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.schema("doc_id bigint, quality int, toxic int").parquet(f"{sf_dir}/labels.parquet")
    return additive.quality_scores(table(spark, sf_dir, "documents"), labels, _fold("doc_id", 4) == 2)


@query(manifest.SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    changed = {"n_chars": F.when(picked, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return manifest.manifest(table(spark, sf_dir, "documents"), "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], "lang", changed)


@query(line_runs.SQL)
def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query()
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_conversations(table(spark, sf_dir, "conversations"))
