"""Digest trees: only branches that differ are read, and a stopped run goes on."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quaylark.operators import digesttree as tree
from quaylark.tables import postings


def branch(key) -> str:
    return hashlib.sha256(("" if key is None else str(key)).encode()).hexdigest()[:2]


def sides(spark, tmp_path, left, right, schema="id long, title string, branch int"):
    return [tree.build(spark.createDataFrame(rows, schema), "id", str(tmp_path / name)) for name, rows in (("l", left), ("r", right))]


def opened(df) -> set[str]:
    return {m for f in df.inputFiles() for m in re.findall(r"branch=(\w\w)", f)}


def found(df):
    return sorted((r["key"] is None, r["key"] or 0, r["action"]) for r in df.collect())


def test_one_changed_row_opens_one_branch(spark, sf_dir, tmp_path):
    rows = postings(spark, sf_dir)
    moved = rows.withColumn("salary", F.col("salary") + F.when(F.col("id") == 7, 1.0).otherwise(0.0))
    left, right = tree.build(rows, "id", str(tmp_path / "l")), tree.build(moved, "id", str(tmp_path / "r"))
    assert tree.unequal_branches(spark, left, right) == [branch(7)]
    d = tree.differences(spark, left, right)
    assert found(d) == [(False, 7, "upsert")]
    assert opened(d) == {branch(7)}
    tree.run(spark, left, right, str(tmp_path / "book"), most=256)
    assert tree.unequal_branches(spark, left, right) == []
    assert tree.rows_of(spark, right).exceptAll(rows).isEmpty() and tree.rows_of(spark, right).count() == rows.count()
    made = {r["branch"]: r["made"] for r in tree.manifest(spark, right).collect()}
    assert {b for b, g in made.items() if g} == {branch(7)}  # the others were not written again


def test_nulls_repeats_and_clashing_names(spark, tmp_path):
    left = [(1, "a", 1), (1, "a", 1), (2, None, 2), (None, "x", 3), (4, "same", None), (5, "", 5)]
    right = [(1, "a", 1), (2, "", 2), (None, "y", 3), (4, "same", None), (5, "", 5), (6, "gone", 6), (6, "gone", 6)]
    l, r = sides(spark, tmp_path, left, right)
    assert found(tree.differences(spark, l, r)) == [(False, 1, "upsert"), (False, 2, "upsert"), (False, 6, "delete"), (True, 0, "upsert")]
    tree.mend(spark, l, r, tree.BRANCHES)
    assert sorted(map(repr, map(tuple, tree.rows_of(spark, r).collect()))) == sorted(map(repr, left))


@pytest.mark.parametrize("left, right", [([], []), ([], [(1, "a", 1)]), ([(1, "a", 1)], [])])
def test_empty_sides(spark, tmp_path, left, right):
    l, r = sides(spark, tmp_path, left, right)
    tree.mend(spark, l, r, tree.BRANCHES)
    assert [tuple(x) for x in tree.rows_of(spark, r).collect()] == left
    assert tree.unequal_branches(spark, l, r) == []
    tree.mend(spark, l, r, tree.BRANCHES)  # and once more on the result
    assert [tuple(x) for x in tree.rows_of(spark, r).collect()] == left


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    left = [(i, "a", i) for i in range(300)]
    l, r = sides(spark, tmp_path, left, [(i, "b" if i % 2 else "a", i) for i in range(320)])
    book, calls, whole = str(tmp_path / "book"), [], tree.mend

    def shaky(s, a, b, branches):
        calls.append(branches[0])
        if len(calls) == 2:
            raise OSError("lost")
        return whole(s, a, b, branches)

    monkeypatch.setattr(tree, "mend", shaky)
    with pytest.raises(OSError):
        tree.run(spark, l, r, book, most=64, full=True)
    assert [x["upto"] for x in tree.history(spark, book).collect()] == [64]
    assert min(tree.unequal_branches(spark, l, r)) >= "40"
    assert tree.run(spark, l, r, book, most=64) == (0, 128)
    assert tree.run(spark, l, r, book, most=64, full=True) == (0, 256)
    assert calls == ["00", "40", "40", "80", "c0"]
    assert sorted(x["id"] for x in tree.rows_of(spark, r).collect()) == list(range(300))
    done = tree.history(spark, book).agg(F.sum("upserts"), F.sum("deletes")).first()
    assert tuple(done) == (150, 20)
    assert tree.run(spark, l, r, book, most=256) == (1, 256)  # the next cycle finds nothing
    assert tree.history(spark, book).where("cycle = 1 AND upserts + deletes > 0").isEmpty()
    with pytest.raises(ValueError):
        tree.run(spark, l, r, book, most=0)
