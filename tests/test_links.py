from __future__ import annotations

import random
import tempfile

import pytest

from conftest import rows
from vigilark.operators.links import linked_groups
from vigilark.plans import rounds


def groups(pairs):
    """Brute force: repeat taking the least label over each link until nothing changes."""
    label = {n: n for pair in pairs for n in pair}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted(label.items())


CASES = {
    "chain": [(i, i + 1) for i in range(0, 60)],
    "hub": [(500, i) for i in range(100)] + [(900, 901)],
    "loops": [(1, 1), (2, 3), (3, 2), (3, 3), (7, 7)],
    "none": [],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_shapes(spark, name):
    links = spark.createDataFrame(CASES[name], "a bigint, b bigint")
    assert rows(linked_groups(links, "a", "b")) == groups(CASES[name])


@pytest.mark.parametrize("seed", range(2))
def test_random_links(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(80)]
    assert rows(linked_groups(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b")) == groups(pairs)


def test_missing_ends_and_text_names(spark):
    links = spark.createDataFrame([("x", "y"), (None, "z"), ("y", "w")], "a string, b string")
    assert rows(linked_groups(links, "a", "b")) == [("w", "w"), ("x", "w"), ("y", "w")]


class Session:
    """Settings and master of a session."""

    def __init__(self, master, folder):
        self.sparkContext = self.conf = self
        self.master, self.folder = master, folder

    def get(self, name, default):
        return self.folder if name == "spark.checkpoint.dir" and self.folder else default


def test_rounds_use_the_folder_the_session_names(spark, tmp_path):
    assert rounds.shared_folder(Session("yarn", "hdfs://shared/x")) == "hdfs://shared/x"
    assert rounds.shared_folder(Session("local[8]", "/shared/x")) == "/shared/x"
    assert rounds.shared_folder(Session("local[8]", None)).startswith(tempfile.gettempdir())
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        rounds.shared_folder(Session("yarn", None))


def test_rounds_keep_the_last_two_tables(spark):
    cut = rounds.Rounds(spark)
    first = cut.cut(spark.range(5))
    second = cut.cut(first.where("id > 1"))
    third = cut.cut(second.where("id > 2"))
    assert third.count() == 2 and third.inputFiles()[0].split("/")[-2] == "0"
