"""The near-dedup stage against all pairs by five-word shingles."""

import random

import pytest

import corpus_pipeline
from quaylark.llm import shingles


def plain_set(text: str, words: int = 5) -> frozenset:
    parts = (text or "").encode().lower().split()
    k = min(words, len(parts))
    return frozenset(b" ".join(parts[i : i + k]) for i in range(len(parts) - k + 1)) if parts else frozenset()


def plain_kept(rows: dict) -> set:
    """Least ids of the groups of all pairs at 0.8 or more."""
    sets, root = {i: plain_set(t) for i, t in rows.items()}, {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n, m = len(sets[a]), len(sets[b])
            if 5 * min(n, m) < 4 * max(n, m):
                continue
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (n + m - shared):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i for i in ids if find(i) == i}


def chains() -> dict:
    """Texts that change word by word, so that ends of a group are unlike, and copies far apart in SimHash."""
    rng, rows = random.Random(4), {}
    for g in range(5):
        words = [f"g{g}w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(30):
            rows[len(rows)] = " ".join(words)
            words[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_chains_and_blocks(spark, block):
    rows = chains() | {900: "", 901: " \n", 902: "One  two", 903: "one two", 904: "lonely"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in shingles.one_of_each(docs, block).collect()} == plain_kept(rows)


def test_stage_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_kept({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()} == want


def test_rows_with_maps_and_clashing_names(spark):
    """Repeated rows with a map beside them: one stays, the least by the map as JSON."""
    docs = spark.sql("SELECT * FROM VALUES (1L, 'same text here', map('k', 2)), (1L, 'same text here', map('k', 1)), (1L, 'same text here', NULL), (2L, 'Same  text here', map('a', 1)), (NULL, NULL, map('x', 9)), (NULL, '', map('x', 9)) AS t(doc_id, text, _NODE)")
    got = shingles.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["_NODE"]) for r in got.where("doc_id IS NOT NULL").collect()) == [(1, None)]
    assert got.where("doc_id IS NULL").count() == 1
