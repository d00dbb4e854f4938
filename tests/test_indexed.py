"""Stored indexes against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quaylark.operators import intervals, searchindex, textsearch, typeahead
from quaylark.storage import stored


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_words_equal_levenshtein_over_all_pairs(spark, tmp_path):
    rnd = random.Random(5)
    words = {"".join(rnd.choices("abñ", k=rnd.randint(1, 6))) for _ in range(150)}
    for n in (31, 32, 33, 34, 35, 60):  # about the length where the keys change
        long = "".join(rnd.choices("abcdefgh", k=n))
        words |= {long, long[1:], long[:-1], long[:7] + "x" + long[8:], long[:-3] + "z" + long[-2:], long[: n // 2] + "y" + long[n // 2 :], "x" + long[1:-1] + "x"}
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(sorted(words))], "id long, name string")
    index = searchindex.build(docs, "id", "name", str(tmp_path / "i"), buckets=4)
    want = {(a, b, distance(a, b)) for a in words for b in words if abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1}
    asked = docs.select(F.col("name").alias("word"))
    assert {tuple(r) for r in searchindex.near(asked, index).collect()} == want
    odd = spark.createDataFrame([(None,), ("",), (min(words),)], "token string")
    pairs = [tuple(r) for r in searchindex.near_all(asked, odd.unionByName(docs.select(F.col("name").alias("token")))).collect()]
    assert len(pairs) == len(want) and set(pairs) == want


def test_a_table_of_searches_scores_as_one_search(spark, sf_dir, tmp_path):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    index = searchindex.build(part, "p_partkey", "p_name", str(tmp_path / "i"), buckets=4)
    searches = ["stel widg", "re bolt", "smll", "bol", "nothing here", "widget widget"]
    df = spark.createDataFrame([(s,) for s in [*searches, *searches, None, ""]], "search string")
    got = {tuple(r) for r in searchindex.answers(df, "search", index).collect()}
    plain = textsearch.inverted_index(part, "p_partkey", "p_name")
    want = {(s, *r) for s in searches for r in textsearch.matched(plain, "p_partkey", s.split()).collect()}
    assert got == want and len(want) > 50


def test_search_index_of_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "red", 0), (3, "red RED", 0), (3, "red", 1), (4, "w" * 5000 + " red", 2)], "id long, name string, token int")
    index = searchindex.build(docs, "id", "name", str(tmp_path / "i"), buckets=2)
    df = spark.createDataFrame([("red",), ("w" * 4999,)], "q string")
    got = sorted(map(tuple, searchindex.answers(df, "q", index).collect()), key=repr)
    assert got == sorted([("red", 3, 1, 0, 1), ("red", 4, 1, 0, 1), ("red", None, 1, 0, 1), ("w" * 4999, 4, 1, 0, 0)], key=repr)
    index = searchindex.build(docs.limit(0), "id", "name", str(tmp_path / "none"), buckets=2)
    assert searchindex.answers(df, "q", index).count() == 0


def test_a_search_reads_buckets_of_the_index_only(spark, sf_dir, tmp_path):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    index = searchindex.build(part, "p_partkey", "p_name", str(tmp_path / "i"), buckets=4)
    words = stored(spark.createDataFrame([("widge",), ("smal",)], "word string"), "words")
    found = searchindex.near(words, index)
    assert {f.split("/i/")[1].split("/")[0] for f in found.inputFiles() if "/i/" in f} == {"neighbours"}
    assert not any("part.parquet" in f for f in found.inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def tree(n, seed):
    rnd = random.Random(seed)
    return [(i, None if i % 40 == 0 else rnd.randrange(max(0, i - 15), i)) for i in range(n)]


@pytest.mark.parametrize("rows", [tree(200, 1), [(i, 0 if i else None) for i in range(700)], [(0, None)]], ids=["deep", "hot parent", "one"])
def test_intervals_equal_a_walk(spark, rows):
    labels = intervals.labelled(spark.createDataFrame(rows, "id long, parent_id long"), max_hops=200).collect()
    parent, at = dict(rows), {r["id"]: r for r in labels}
    below = {i: {i} for i in parent}
    for i in parent:
        up = parent[i]
        while up is not None:
            below[up].add(i)
            up = parent[up]
    for i, r in at.items():
        assert r["size"] == len(below[i]) and {j for j, x in at.items() if r["first"] <= x["first"] <= r["last"]} == below[i]
    assert len(at) == len(rows)


def test_intervals_of_odd_rows(spark):
    rows = [(1, None), (1, None), (2, 1), (2, 5), (5, 1), (3, 99), (None, 1), (7, 8), (8, 7), (9, 8), (4, 4)]
    labels = intervals.labelled(spark.createDataFrame(rows, "id long, parent_id long")).collect()
    assert {(r["id"], r["parent_id"], r["depth"], r["size"]) for r in labels} == {(1, None, 0, 3), (2, 1, 1, 1), (5, 1, 1, 1), (3, None, 0, 1)}
    assert intervals.labelled(spark.createDataFrame([], "id string, parent_id string")).count() == 0


def test_a_subtree_is_one_range_in_the_scan(spark):
    labels = stored(intervals.labelled(spark.createDataFrame(tree(300, 2), "id long, parent_id long"), max_hops=200), "labels")
    plan = intervals.subtree(labels, 45)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(first" in plan and "LessThanOrEqual(first" in plan and "Join" not in plan
    assert intervals.subtree(labels, -1).count() == 0
    roots = spark.createDataFrame([(45,), (45,), (0,)], "id long")
    assert {tuple(r) for r in intervals.subtrees(labels, roots).collect()} == {(i, intervals.subtree(labels, i).count()) for i in (0, 45)}


def best(state, typed, k):
    hits = [(not n.lower().startswith(typed), -(-1e9 if w is None else w), key) for key, (n, w) in state.items() if n and any(t.startswith(typed) for t in n.lower().split())]
    return [key for _, _, key in sorted(hits)[:k]]


def test_typeahead_follows_inserts_moves_and_removals(spark, tmp_path):
    rnd = random.Random(3)
    name = lambda: " ".join(rnd.choice(["Ana", "anabel", "Anna", "bar", "baring", "longestwordsever", "longestwordsonce", "C++"]) for _ in range(rnd.randint(1, 3)))
    state = {i: (name(), rnd.choice([None, 1.0, 2.0, 3.0])) for i in range(60)} | {60: (None, 1.0), 61: ("", 1.0)}
    schema = "id long, name string, weight double, prefix string, gone boolean"
    frame = lambda rows: spark.createDataFrame([(i, n, w, "x", g) for i, n, w, g in rows], schema)
    index = typeahead.build(frame([(i, *v, False) for i, v in state.items()] + [(None, "ana", 9.0, False)]), "id", "name", "weight", str(tmp_path / "t"), k=3, buckets=4)

    def same():
        got = {}
        for r in typeahead.lists(spark, index).orderBy("prefix", "place").collect():
            got.setdefault(r["prefix"], []).append(r["key"])
        prefixes = {t[:n] for v in state.values() for t in (v[0] or "").lower().split() for n in range(1, min(len(t), typeahead.LONGEST) + 1)}
        assert got == {p: best(state, p, 3) for p in prefixes}

    same()
    for step in range(2):
        top = [best(state, "an", 3)[0], best(state, "ba", 3)[0]]  # the lists must fill up again
        rows = [(i, None, None, True) for i in top] + [(i, name(), 5.0 + step, False) for i in (7, 100 + step) if i not in top] + [(999, "x", None, True)]
        typeahead.apply(index, frame(rows + rows), "id", "name", "weight", F.col("gone"))
        for i, n, w, gone in rows:
            state.pop(i, None) if gone else state.update({i: (n, w)})
        same()
    assert [r["key"] for r in typeahead.suggest(spark, index, "LONGESTWORDSO").collect()] == best(state, "longestwordso", 3)
    assert [r["key"] for r in typeahead.suggest(spark, index, "an").collect()] == best(state, "an", 3)
    assert typeahead.suggest(spark, index, "").count() == 0
    before = typeahead.lists(spark, index).collect()
    assert typeahead.apply(index, frame([]), "id", "name", "weight", F.col("gone")) == 3
    assert sorted(typeahead.lists(spark, index).collect()) == sorted(before)


def test_a_suggestion_reads_one_bucket(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"name{i} word", i * 1.0) for i in range(50)], "id long, name string, weight double")
    index = typeahead.build(rows, "id", "name", "weight", str(tmp_path / "t"), buckets=8)
    found = typeahead.suggest(spark, index, "word")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "/entries" not in plan
    assert [r["key"] for r in found.collect()] == list(range(49, 39, -1))


def test_typeahead_of_an_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], "id string, name string, weight double, gone boolean")
    index = typeahead.build(rows, "id", "name", "weight", str(tmp_path / "t"), buckets=2)
    assert typeahead.lists(spark, index).count() == 0
    typeahead.apply(index, spark.createDataFrame([("a", "Ana", None, None)], rows.schema), "id", "name", "weight", F.col("gone"))
    assert [tuple(r) for r in typeahead.suggest(spark, index, "an").collect()] == [(1, "a", "Ana", None)]
