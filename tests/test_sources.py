from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from conftest import rows
from vigilark.functions import hooks
from vigilark.sources import scan, sinks

SCHEMA = StructType().add("k", "long").add("v", "string")


def test_checked_scan_names_what_is_wrong(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT 1 AS k, 'x' AS v, 2 AS more").write.parquet(path)
    differences = scan.schema_differences(StructType.fromDDL("k bigint, w string"), spark.read.parquet(path).schema)
    assert differences == [("k", "retyped", "bigint", "int"), ("w", "missing", "string", None), ("v", "extra", None, "string"), ("more", "extra", None, "int")]
    with pytest.raises(scan.SchemaMismatch, match="k: retyped"):
        scan.checked_scan(spark, path, SCHEMA)
    assert scan.checked_scan(spark, path, StructType.fromDDL("v string, k int")).columns == ["v", "k"]


@pytest.mark.parametrize("format", ["parquet", "orc"])
def test_every_file_is_held_to_the_schema(spark, tmp_path, format):
    path = tmp_path / "many files"
    for i in range(7):
        spark.sql(f"SELECT {i}L AS k, {'5L' if i == 5 else repr('x')} AS v").write.format(format).save(f"{path}/d={i}")
    with pytest.raises(scan.SchemaMismatch, match="d=5/.*: v: retyped, declared string, found bigint"):
        scan.checked_scan(spark, str(path), SCHEMA, format)
    name, differences = scan.first_differing_file(spark, str(path), SCHEMA, format)
    assert "d=5" in name and differences == [("v", "retyped", "string", "bigint")]
    only_k = StructType().add("k", "long")
    assert scan.first_differing_file(spark, str(path), only_k, format) is None
    assert rows(scan.checked_scan(spark, str(path), only_k, format)) == [(i,) for i in range(7)]


def test_a_column_that_some_files_lack_is_null_there(spark, tmp_path):
    path = str(tmp_path / "some")
    spark.sql("SELECT 1L AS k").write.parquet(f"{path}/d=1")
    spark.sql("SELECT 2L AS k, 'x' AS v").write.parquet(f"{path}/d=2")
    assert rows(scan.checked_scan(spark, path, SCHEMA)) == [(1, None), (2, "x")]


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_formats(spark, tmp_path, format):
    path = str(tmp_path / format)
    spark.createDataFrame([(1, "a"), (2, None)], SCHEMA).write.format(format).save(path)
    assert rows(scan.checked_scan(spark, path, SCHEMA, format)) == [(1, "a"), (2, None)]


def test_text_rows_that_do_not_fit_fail(spark, tmp_path):
    path = str(tmp_path / "bad")
    spark.createDataFrame([("one,a",)], "line string").write.text(path)
    with pytest.raises(Exception, match="(?i)malformed"):
        scan.checked_scan(spark, path, SCHEMA, "csv").collect()


def test_partition_overwrite_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "parts")
    sinks.write_partitioned(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), path, ["v"])
    sinks.write_partitioned(spark.createDataFrame([(9, "b")], SCHEMA), path, ["v"])
    assert rows(spark.read.parquet(path), "k", "v") == [(1, "a"), (9, "b")]


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    names = ["bucketed_left", "bucketed_right"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in names:
            sinks.write_bucketed(spark.range(1000).withColumn(f"{name}_v", F.rand()), name, ["id"], 4)
        joined = spark.table(names[0]).join(spark.table(names[1]), "id")
        assert joined.count() == 1000
        assert "Exchange" not in joined._jdf.queryExecution().sparkPlan().toString()
        assert "Exchange hash" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_hooks(spark):
    df = spark.createDataFrame([(1.0, "a", '{"x": 1}'), (100.0, None, "broken"), (None, "a", None)], "value double, event_type string, j string")
    hooks.register_scalar(spark, "band_of", hooks.value_band, "string")
    assert rows(df.select("value", F.call_function("band_of", "value").alias("b"))) == [(None, None), (1.0, "low"), (100.0, "high")]
    parts = hooks.batch_partials(df.select("event_type", "value"), hooks.log_sums, "event_type string, n bigint, log_sum double")
    assert rows(parts.groupBy("event_type").agg(F.sum("n"))) == [(None, 1), ("a", 1)]
    hooks.register_table(spark, "entries_of", hooks.JsonEntries, "name string, text string")
    assert rows(spark.sql("SELECT t.name, t.text FROM {d} d, LATERAL entries_of(d.j) t", d=df)) == [("x", "1")]
