from __future__ import annotations

import pytest

from vigilark.llm import line_rules, registry

from compare import connect, difference

SENTENCE = "The quick brown fox jumps over the lazy dog near the old river bank today."


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words string")
    return {r["doc_id"]: r for r in line_rules.clean_lines(docs).collect()}


def test_against_sql_on_given_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [None, "", " \n\t", "a b c d e a b c d e f", "x " * 3000, "a\nb\n\na \na\n\nb", "é ü | » …   .", "### $$$ \n!!!! a.", "one\rtwo\x0bthree.\n" * 40]
    both = docs.unionByName(spark.createDataFrame([(10**6 + i % 8, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    both.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = connect(str(tmp_path))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    got = line_rules.clean_lines(spark.read.parquet(str(tmp_path / "d"))).drop("clean_text")
    assert difference(got, con, registry.SQL["op1_line_rules"]) is None


def test_lines_go_first_then_documents(spark):
    clean = "\n".join(" ".join(f"word{i}{k}" for k in range(12)) + "." for i in range(5))
    got = run(
        spark,
        [
            (1, clean + "\nHome | News | Sport | Contact", "x", "y"),
            (2, "\n".join(["menu | a | b | c"] * 5) + "\n" + SENTENCE, "x", "y"),
            (3, None, "x", "y"),
            (4, "All rights reserved to us and to you and to them.\n" + clean, "x", "y"),
        ],
    )
    assert got[1]["kept"] and got[1]["clean_text"] == clean
    assert not got[2]["kept"] and got[3]["base_failed"] and got[3]["clean_text"] == ""
    assert got[4]["kept"] and got[4]["n_failed_lines"] == 1


def test_verdicts_follow_the_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 0")
    got = registry.QUERIES["op1_line_rules"](spark, folder).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, True), 0) >= 0.97 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.6 * (n.get((0, True), 0) + n.get((0, False), 0)), n


def test_no_shuffle_and_no_python(spark):
    plan = line_rules.clean_lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("rows", [[]])
def test_empty(spark, rows):
    assert run(spark, rows) == {}
