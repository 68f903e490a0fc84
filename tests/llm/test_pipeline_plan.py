from __future__ import annotations

import corpus_pipeline


def test_lines_are_judged_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = corpus_pipeline.quality_rules(spark, docs, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lorem ipsum") == 1
