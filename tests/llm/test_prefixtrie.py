"""The trie of conversations against a plain walk over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quaylark.llm import prefixtrie, queries, sql

TURNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    number, members, parent, depth, chars, last = {}, defaultdict(list), [None], [0], [0], {}
    for c, turns in built.items():
        node = 0
        members[0].append(c)
        for role, text in turns:
            up, node = node, number.setdefault((node, role, text), len(parent))
            if node == len(parent):
                parent.append(up), depth.append(depth[up] + 1), chars.append(len(text))
            members[node].append(c)
        last[c] = node
    if not members:
        return []
    children, leaves, saved, size = ([0] * len(parent) for _ in range(4))
    for node in range(len(parent) - 1, -1, -1):  # children come after their parents
        leaves[node] += children[node] == 0
        saved[node] += (len(members[node]) - 1) * chars[node]
        size[node] += 1
        if node:
            for x in (leaves, saved, size):
                x[parent[node]] += x[node]
            children[parent[node]] += 1
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if last[c] == node)
        up = min(members[parent[node]]) if node else None
        out.append((min(convs), depth[node], up, len(convs), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(), size[node]))
    return sorted(out)


def found(df):
    rows = df.collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))  # preorder ranks: all places, once
    return sorted((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"], r["last"] - r["rank"] + 1) for r in rows)


def test_same_rows_as_sql(spark, sf_dir, duck, same):
    same(queries.op13_prefix_trie(spark, sf_dir), duck, sql.prefix_trie_sql())


def test_random_conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(130), 200, 203, 250, 1000, 1007]:
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["", "a", "b", None, "é😀"])) for _ in range(rng.choice([1, 1, 2, 3, 6, 9]))]
        rows += [(c, i if rng.random() > 0.1 else None, *t) for i, t in enumerate(turns)]
    rows += [(5, 3, "user", "tie"), (5, 3, "user", "tie"), (5, 3, "assistant", "tie"), (None, 1, "user", "lost"), (7, 0, "user", "x" * 3000)]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], TURNS + ", depth int, key string").repartition(5)
    assert found(prefixtrie.prefix_trie(df)) == plain(rows)


def test_chain_of_extensions_and_a_hot_conversation(spark):
    # each conversation goes on where the one before it ends; one has most of the rows, many equal
    rows = [(600 + c, t, "user", str(t)) for c in range(40) for t in range(c)] + [(777, t // 50, "user", str(t // 100)) for t in range(4000)]
    got = prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS))
    assert found(got) == plain(rows)


def test_equal_conversations_share_their_ends(spark):
    rows = [(c, 0, "user", "hi") for c in range(3000, 3000 + 20_000, 1)]
    got = {r["depth"]: r for r in prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()}
    want = {r[1]: r for r in plain(rows)}
    assert got.keys() == want.keys()
    assert all(got[d]["ends_sha256"] == want[d][7] and got[d]["n_convs"] == want[d][3] for d in want)


def test_no_rows(spark):
    df = spark.createDataFrame([(None, 1, "user", "x")], TURNS)
    assert prefixtrie.prefix_trie(df).count() == 0
    assert prefixtrie.prefix_trie(df.limit(0)).count() == 0
    one = prefixtrie.prefix_trie(spark.createDataFrame([(101, None, None, None)], TURNS)).collect()
    assert sorted((r["depth"], r["n_convs"]) for r in one) in ([(0, 1)], [(0, 1), (1, 1)])
