"""SimHash links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quaylark.llm import simhash
from quaylark.llm.components import components


def plain_fingerprint(text: str, words: int = 4) -> int:
    table = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    low = "".join(table.get(c, c) for c in text)
    parts = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(fps: dict[int, list]) -> dict:
    """Least id reachable of each fingerprint, by comparing all pairs."""
    keys = list(fps)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4:
                root[find(a)] = find(b)
    least: dict = {}
    for k in keys:
        ids = [i for i in fps[k] if i is not None]
        if ids:
            least[find(k)] = min([*ids, least.get(find(k), min(ids))])
    return {k: least.get(find(k)) for k in keys}


@pytest.mark.parametrize("text", ["", " \n\t", "one", "A b", "a b c d", "Ä ä A a É é x y z", "x y z w", "the cat sat on the mat " * 40])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_fingerprint_uses_the_engine_s_hash(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("ein wörtchen"))).first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest("ein wörtchen".encode(), 42)


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "lonely words here now"), (None, None), (-5, ""), (-6, "  "), (-7, "a b"), (-7, "a b")], "doc_id long, text string"))
    rows = docs.collect()
    fps: dict[int, list] = {}
    for doc_id, text in rows:
        fps.setdefault(plain_fingerprint(text or ""), []).append(doc_id)
    want = brute(fps)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[int(r["fingerprint"], 16)]
        assert r["doc_id"] in fps[int(r["fingerprint"], 16)]


@pytest.mark.parametrize("key_rows", [8192, 40])
def test_dense_groups_and_chains(spark, key_rows):
    """Near copies around centres, and chains whose ends are far apart; small keys force the block-wise way."""
    rng = random.Random(9)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(80):
            fps.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 5))}))
        walk = centre
        for _ in range(15):
            walk ^= sum({1 << rng.randrange(64) for _ in range(4)})
            fps.add(walk)
    fps |= {rng.getrandbits(64) for _ in range(500)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = brute({f: [f] for f in signed})
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(df, 4, key_rows)).collect()}
    assert {f: roots.get(f, f) for f in signed} == want


def test_thresholds_cover_the_distance(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(2000)], "fp long")
    parts = simhash.plan(df, 4)
    bits = [b for p, _ in parts for b in p]
    assert len(bits) == len(set(bits))
    assert sum(t for _, t in parts) >= 4 - len(parts) + 1
    assert simhash.allocate([[1.0, 9.0], [2.0, 3.0], [50.0, 60.0]], 0) == (4.0, [0, 1, -1])


def test_spanning_links_grow_with_members():
    centre = 0x0F0F0F0F0F0F0F0F
    fp = np.array([centre ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)], np.int64)
    assert len(simhash.spanning_links(np.unique(fp), 4)) == len(np.unique(fp)) - 1


def test_one_of_each_keeps_columns_and_clean_rows(spark):
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(1, long, "x"), (2, long, "y"), (3, long + " tail", "z"), (4, "quite another text of its own " + long[::-1], "w"), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_star_and_a_path(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(i, 0) == 0 for i in range(400))
    assert all(got.get(1000 + i, 1000) == 1000 for i in range(61))


def test_one_row_of_each_group_whatever_its_id(spark):
    """Rows without an id stay where their text is unique; of repeated ids and texts one row stays."""
    far = [" ".join(f"{name}{i}" for i in range(60)) for name in ("lone", "pair", "same")]
    rows = [(None, far[0], "a"), (None, far[1], "b"), (8, far[1], "c"), (7, far[2], "e"), (7, far[2], "d"), (7, far[2], "d"), (None, far[2], "f"), (None, None, "g"), (None, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = simhash.one_of_each(docs).select("doc_id", "source").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, "a"), (8, "c"), (7, "d"), (None, "g")], key=repr)
