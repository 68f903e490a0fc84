from __future__ import annotations

from vigilark.llm.templates import not_checkable, template_matches

ITEM = "A train leaves the old station with 40 km to go and Anna waits for Bob, who said that Anna owes 12 dollars to the baker near the square."


def run(spark, docs, items=((1, ITEM),), **options):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, coverage string")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in template_matches(d, b, **options).collect()}


def test_planted_passages(spark):
    fill = " ".join(f"filler{i}" for i in range(40))
    other = ITEM.replace("40", "75").replace("Anna", "Carla").replace("12 dollars", "9 euros").replace("Bob", "Dan")
    mixed = ITEM.replace("Anna waits", "Carla waits").replace("40", "75").replace("12", "40").replace("Bob", "Anna").replace("Anna owes", "Eve owes")
    got = run(
        spark,
        [(1, f"{fill}. {ITEM} {fill}", "", ""), (2, f"{fill} {other}", "", ""), (3, fill, "", ""), (4, None, "", ""), (5, "", "", ""), (None, ITEM, "", ""), (7, ITEM[:60], "", ""), (8, ITEM.upper(), "", ""), (9, ITEM, "", ""), (9, ITEM, "", "")],
    )
    assert set(got) == {(1, 1), (2, 1), (None, 1), (8, 1), (9, 1)}
    assert got[8, 1]["exact"] and got[8, 1]["coverage"] == 1.0
    assert got[1, 1]["exact"] and got[1, 1]["coverage"] == 1.0
    # Five of the six values of the item stand for one value each, "Anna" for two.
    assert run(spark, [(10, mixed, "", "")])[10, 1]["n_consistent"] == 5
    assert run(spark, [(10, mixed, "", "")], consistent=0.9) == {}
    assert not got[2, 1]["exact"] and got[2, 1]["n_slots"] == got[2, 1]["n_consistent"] == 6


def test_short_and_repeated_items_and_empty_tables(spark):
    items = [(1, ITEM), (2, ITEM), (3, "too short"), (4, None), (5, "")]
    assert set(run(spark, [(1, ITEM, "", "")], items)) == {(1, 1), (1, 2)}
    assert run(spark, [], items) == {}
    assert run(spark, [(1, ITEM, "", "")], []) == {}


def test_every_given_passage_is_found_and_little_else(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    held = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if i["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in template_matches(docs, items).select("doc_id", "item_id").collect()}
    assert held and held <= got and len(got - held) <= 0.02 * docs.count()


def test_each_occurrence_is_judged_by_itself(spark):
    twin = ITEM.replace("40", "75").replace("Anna", "Carla").replace("12 dollars", "9 euros").replace("Bob", "Dan")
    third = ITEM.replace("40", "31").replace("Anna", "Fay").replace("12 dollars", "7 pounds").replace("Bob", "Gus")
    moved = third.replace("and Fay", "and then slowly Fay")
    got = run(spark, [(1, f"{ITEM} {twin}", "", ""), (2, f"{twin} {third}", "", ""), (3, f"{twin} so it went on. {moved}", "", "")])
    assert set(got) == {(1, 1), (2, 1), (3, 1)}
    assert got[1, 1]["exact"] and got[1, 1]["coverage"] == 1.0
    assert not got[2, 1]["exact"] and got[2, 1]["n_slots"] == got[2, 1]["n_consistent"]


def test_items_without_usual_windows(spark):
    table_like = " ".join(f"word{i} {i} {i + 50} {i + 90} {i + 130}" for i in range(6))
    items = [(1, "What is the capital of Peru?"), (2, table_like), (3, "3 5 8"), (4, "x1 is 7"), (5, "seven words have this short item here")]
    docs = [
        (1, "He asked: WHAT IS the capital of Peru? Nobody knew.", "", ""),
        (2, f"before {table_like} after", "", ""),
        (3, f"before {table_like.replace('130', '777')} after", "", ""),
        (4, "it goes 3 5 8 and on", "", ""),
        (5, "it goes 3 5 9 and on", "", ""),
        (6, "then seven words have this short item here.", "", ""),
        (7, "what is the capital", "", ""),
    ]
    assert set(run(spark, docs, items)) == {(1, 1), (2, 2), (3, 2), (4, 3), (6, 5)}


def test_very_short_items_match_nothing_and_are_listed(spark):
    items = [(1, "Yes"), (2, "42"), (3, "The"), (4, ""), (5, None), (6, "...")]
    docs = [(1, "Yes, the answer is 42. The end.", "", ""), (2, "the the the", "", "")]
    assert run(spark, docs, items) == {}
    listed = not_checkable(spark.createDataFrame([*items, (7, "one two three")], "item_id long, text string"))
    assert {r["item_id"] for r in listed.collect()} == {1, 2, 3, 4, 5, 6}


def test_given_passages_in_capitals_are_found(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(3).collect()]
    got = run(spark, [(i, f"SOME TEXT BEFORE IT. {t.upper()} AND AFTER", "", "") for i, t in items], items)
    assert set(got) == {(i, i) for i, _ in items}
