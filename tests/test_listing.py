"""Listing by tasks against a walk of the same tree."""

import os

import pytest
from pyspark.sql import functions as F

from lakeops.sources import listing
from lakeops.sources.files import first_lines, list_files, list_objects, read_objects


@pytest.fixture
def tree(tmp_path):
    names = [f"{a}/{b}/f{i} é%20+#.txt" for a in "abc" for b in ("x", "y z", "n%31") for i in range(7)]
    names += ["top.csv", "a/.hidden", "_temporary/part", "a/_SUCCESS", "day=1/_x=1", "deep/" + "/".join("d" * 12) + "/end.csv"]
    for i, name in enumerate(names):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("h" * i)
    return tmp_path


def walked(root):
    out = {}
    for folder, folders, names in os.walk(root):
        folders[:] = [d for d in folders if not listing.is_hidden(d)]
        out |= {f"file:{folder}/{n}": os.path.getsize(f"{folder}/{n}") for n in names if not listing.is_hidden(n)}
    return out


@pytest.mark.parametrize("budget", [1, 5, 10**6])
def test_every_file_is_found_once(spark, tree, budget):
    got = [(r.path, r.size) for r in listing.walk_files(spark, str(tree), budget=budget).collect()]
    assert len(got) == len(set(got)) and dict(got) == walked(tree)


def test_it_finds_what_sparks_index_finds(spark, tree):
    index = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tree)).select("path", "length")
    found = sorted(map(tuple, list_files(spark, str(tree)).where("size > 0").collect()))  # Spark's readers leave out empty files
    assert found == sorted(map(tuple, index.collect()))
    named = [r.path.rsplit("/", 1)[1] for r in list_files(spark, str(tree), "*.csv").collect()]
    assert sorted(named) == ["end.csv", "top.csv"]


def test_several_roots_files_and_absent_ones(spark, tree):
    roots = [f"{tree}/a", f"{tree}/top.csv"]
    assert {r.path for r in list_files(spark, roots).collect()} == {p for p in walked(tree) if p.startswith((f"file:{tree}/a/", f"file:{tree}/top"))}
    assert list_files(spark, f"{tree}/empty" if (tree / "empty").mkdir() else f"{tree}/empty").isEmpty()
    with pytest.raises(FileNotFoundError):
        list_files(spark, f"{tree}/absent")


def test_the_driver_is_sent_no_listing(spark, tree):
    """What the listing reads are tables of its rounds; no file index was built over the tree."""
    plan = listing.walk_files(spark, str(tree), budget=4)._jdf.queryExecution().toString()
    assert "binaryFile" not in plan and str(tree) not in plan


def test_odd_names_are_opened(spark, tree):
    keys = {r.key: len(r.content) for r in read_objects(spark, str(tree)).collect()}
    assert keys == {p.removeprefix(f"file:{tree}/"): n for p, n in walked(tree).items()}
    lines = first_lines(list_objects(spark, str(tree)).where(F.col("size") > 0))
    assert lines.where("first_line LIKE 'h%'").count() == sum(n > 0 for n in walked(tree).values())
