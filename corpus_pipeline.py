"""From raw documents to packed token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared folder and reads them as the next one's docs.
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vigilark.llm.apportion import mix
from vigilark.llm.jaccard_join import jaccard_join
from vigilark.llm.line_rules import clean_lines
from vigilark.llm.packing import pack
from vigilark.llm.templates import template_matches
from vigilark.plans.rounds import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules are cut out; rejected documents go."""
    judged = clean_lines(docs, keep=("lang", "source")).select("doc_id", "clean_text", "lang", "source", "kept")
    # One element each: Spark would push the verdict through a projection and judge every line again for it.
    once = judged.select(F.inline(F.array(F.struct("*"))))
    return once.where("kept").select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the least id stays; texts without words are in no class and stay."""
    linked = jaccard_join(docs)
    first = linked.where("group_id is not null").groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("d"))
    chosen = first.select(F.col("d.doc_id").alias("_id"), F.col("d.text_hash").alias("_hash")).distinct()
    hashed = docs.withColumn("_text_hash", F.xxhash64("text"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    one = hashed.where(worded).join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    return one.dropDuplicates(["doc_id", "_text_hash"]).select(*COLUMNS).unionByName(docs.where(~worded).select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other numbers, names or units, go."""
    benchmark = spark.read.schema("item_id bigint, text string").parquet(f"{sf_dir}/benchmark.parquet")
    found = template_matches(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    test = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(found, test, "left_anti").select(*COLUMNS)


@F.pandas_udf(StringType())
def _cut(text: pd.Series, spans: pd.Series, turn: pd.Series) -> pd.Series:
    """The words of the spans that are taken ``turn`` times or more; the text as it is if these are all."""

    def one(t: str, taken, k: int) -> str:
        runs: list[list[int]] = []
        for s in taken:
            if s["times"] >= k:
                if runs and runs[-1][1] == s["start"]:
                    runs[-1][1] = s["end"]
                else:
                    runs.append([s["start"], s["end"]])
        places = [m.span() for m in _WORD.finditer(t)]
        if len(runs) == 1 and runs[0] == [0, len(places)]:
            return t
        return "\n".join(t[places[a][0] : places[b - 1][1]] for a, b in runs)

    return pd.Series([one(t, s, k) for t, s, k in zip(text, spans, turn)])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a document taken k times is k rows, and one taken in part is cut to the words taken."""
    taken = mix(docs, keep=("text", "lang", "source")).where("taken > 0")
    turns = taken.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform("spans", lambda x: x["times"])))))
    cut = turns.select("doc_id", _cut("text", "spans", "turn").alias("text"), "lang", "source")
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def token_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token rows", token_rows),
]

#: The join, the seeded mix and the tokenizer are not expressible in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
