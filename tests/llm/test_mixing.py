"""Mixing against plain water-filling, and the balance that the cube method promises."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylark.llm import mixing, prefixsums, queries

DOCS = "doc_id long, source string, text string"


def words(text) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes: dict) -> dict:
    """Shares by weight; whatever is above the limit is fixed there and the rest shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        share = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in above}


def test_whole_table(spark, sf_dir):
    docs = {r["doc_id"]: r for r in queries.documents(spark, sf_dir).collect()}
    got = queries.op11_mixing(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    sizes, taken = Counter(), Counter()
    for r in docs.values():
        sizes[r["source"]] += words(r["text"])
    want = plain_targets(sizes)
    for r in got:
        d = docs[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (words(d["text"]), sizes[d["source"]])
        assert r["target"] == pytest.approx(want[d["source"]])
        assert r["taken"] in [k * r["size"] for k in range(4)]
        taken[d["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in want)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op11_mixing(spark, sf_dir).collect()))


def test_capped_sources(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 1, "é": 400, None: 50, "": 0}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)
    assert got["a"] == 30 and got[""] == 0


def test_odd_rows(spark):
    rows = [(1, "a", "x y z"), (1, "a", "x y z"), (1, "a", "p q r"), (None, "a", "one"), (None, None, "two words"), (2, None, None), (3, "b", ""), (4, "b", "w " * 5000), (5, "c", " \t\n")]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], DOCS + ", size int, target string")
    got = mixing.takes(docs).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, words(t)) for i, s, t in rows)
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in got)
    assert mixing.takes(docs.limit(0)).count() == 0
    assert mixing.takes(docs.where("doc_id = 5")).first()["target"] == 0


def test_equal_rows_lie_in_many_blocks(spark):
    docs = spark.range(9000).select(F.lit(7).cast("long").alias("doc_id"), F.when(F.col("id") < 6000, "hot").otherwise("cold").alias("source"), F.lit("same three words").alias("text"))
    got = mixing.takes(docs, block=100).groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert {r["source"]: r["n"] for r in got} == {"hot": 6000, "cold": 3000}
    assert all(abs(r["taken"] - r["target"]) <= 6 for r in got)


def test_flight_keeps_both_totals_and_probabilities():
    rng = np.random.default_rng(1)
    size = np.sort(rng.lognormal(4, 1.5, 60).round())[::-1]
    p = rng.uniform(0.05, 0.95, 60)
    mean = np.zeros(60)
    for k in range(400):
        out = mixing.flight(p.copy(), size, np.random.default_rng(k))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out.sum() == pytest.approx(p.sum()) and out @ size == pytest.approx(p @ size)
        mean += out / 400
    assert np.abs(mean - p).max() < 0.12
    alike = mixing.flight(np.full(50, 0.3), np.full(50, 4.0), rng)
    assert alike.sum() == pytest.approx(15) and ((alike > 0) & (alike < 1)).sum() <= 2


def test_landing_takes_the_nearest_choice():
    got = mixing.landing(np.array([0.5, 1.0, 0.25, 0.5]), np.array([8.0, 5.0, 4.0, 1.0]))
    assert got.tolist() == [0.0, 1.0, 1.0, 1.0]  # 5.5 expected, 5 taken, the one besides stays


def test_mixed_rows(spark):
    rows = [(i % 40, "ab"[i % 2], "w " * (i % 7 + 1), i) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS + ", extra int")
    taken = mixing.takes(docs)
    out = mixing.mixed(docs, taken)
    assert out.columns == docs.columns
    total = defaultdict(int)
    for r in out.collect():
        total[r["source"]] += words(r["text"])
    assert total == {r["source"]: r["n"] for r in taken.groupBy("source").agg(F.sum("taken").alias("n")).collect()}


def test_running_sums_over_ranges(spark):
    rows = [(k % 5 * (k % 3), k, k * 7919 % 101, (1 << 61) + k) for k in range(500)] + [(99, k, 1, 1) for k in range(500, 1500)]
    df = spark.createDataFrame(rows, "g long, k long, x long, big long").repartition(7)
    got = {r["k"]: (r["x"], r["big"]) for r in prefixsums.running_sums(df, ["g", "k"], ["x", "big"], "g").collect()}
    sums, last = [0, 0], None
    for g, k, x, big in sorted(rows):
        sums = [x, big] if g != last else [sums[0] + x, sums[1] + big]
        last = g
        assert got[k] == (sums[0], sums[1] & prefixsums.MASK)
    whole = {r["k"]: r["x"] for r in prefixsums.running_sums(df, ["k"], ["x"]).collect()}
    assert whole[1499] == sum(r[2] for r in rows)
    assert prefixsums.running_sums(df.limit(0), ["k"], ["x"]).count() == 0
