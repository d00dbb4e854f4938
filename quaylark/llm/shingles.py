"""Near copies by the shingles that two texts share: linked at a Jaccard similarity of 0.8 or more.

Candidates come from two sides. SimHash fingerprints of five-word shingles within 4 bits
(``simhash.links``) find most texts that differ in a few words only. Texts at 0.8 differ in
10 of 64 bits on average, which no partition of 64 bits can probe at scale, so MinHash bands
add the others: of each text the least of ``BANDS * ROWS`` hashes over its shingles, ``ROWS``
of them to a key. Two texts of similarity s share a key with probability
1 - (1 - s^ROWS)^BANDS: 0.99993 at 0.8. No candidate is linked unverified: similarity is
counted over the sets of shingle hashes (32 bits of a 64-bit hash).

Each key first compares its members with its least member, so its candidates grow with its
members and not with their pairs. Keys whose members are still in several groups then
compare the members of different groups with each other, in tasks of two blocks of
``BLOCK`` members at most.

Edge cases: texts without a word (null, empty, blank) are alike; fewer words than a shingle
make one shingle of all words; case (A-Z) and white space do not count; an empty table gives
no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import in_batches, one_row_each, slices, stored, text_hash, texts_of
from .components import components

WORDS, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 24, 5
#: Members of one key that a task compares with as many others.
BLOCK = 256
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(SEED + 1).integers(0, 1 << 63, (2, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of all word shingles of a text."""
    parts = text.encode().lower().split()  # on bytes: only A-Z, only ASCII white space
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    k = min(words, len(parts))
    edges = zip((ends - sizes)[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in edges), np.uint64, len(parts) - k + 1)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct shingles, 32 bits of each hash."""
    return np.unique((shingle_hashes(text) >> np.uint64(32)).astype(np.uint32))


def band_keys(text: str) -> np.ndarray:
    """A key for each band."""
    hashes = shingle_hashes(text)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        mixed = hashes[at : at + 512, None] * _FACTORS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(31))).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    rows = (rows ^ (rows >> np.uint64(29))) * _MIX[0]
    key = ((rows ^ (rows >> np.uint64(32))) * _MIX[1]).sum(axis=1, dtype=np.uint64)
    return (key * np.uint64(32) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach ``SIMILARITY``; empty sets are alike."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= SIMILARITY * (len(a) + len(b) - shared) - 1e-9


def _keys(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = np.concatenate([band_keys(t) for t in texts_of(b)]) if b.num_rows else np.zeros(0, np.int64)
            nodes = np.repeat(b.column("node").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes)], ["key", "node"])

    return in_batches(texts, run, "key long, node long")


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = pa.array([shingle_set(t).tobytes() for t in texts_of(b)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("node"), sets], ["node", "own"])

    return in_batches(texts, run, "node long, own binary")


def _verified(pairs: DataFrame) -> DataFrame:
    """(u, v) of the rows (u, v, a, b) whose sets a and b are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = zip(b.column("a").to_pylist(), b.column("b").to_pylist())
            keep = pa.array([similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in sets], pa.bool_())
            yield b.select(["u", "v"]).filter(keep)

    return in_batches(pairs, run, "u long, v long")


def block_links(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Similar pairs that join groups: members of one root are not compared, nor those joined on the way."""
    order = np.argsort(nodes, kind="stable")
    nodes, roots, sets = nodes[order], roots[order].copy(), [sets[i] for i in order]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for i in range(len(nodes) - 1):
        near = (roots != roots[i]) & (np.minimum(sizes, sizes[i]) >= SIMILARITY * np.maximum(sizes, sizes[i]))
        near[: i + 1] = False
        if not near.any():
            continue
        mark = np.zeros(len(values) + 1, np.int64)
        mark[at[sums[i] : sums[i + 1]]] = 1
        for j in np.flatnonzero(near).tolist():
            if roots[j] == roots[i]:
                continue
            shared = int(mark[at[sums[j] : sums[j + 1]]].sum())
            if shared >= SIMILARITY * (sizes[i] + sizes[j] - shared) - 1e-9:
                out.append((int(nodes[i]), int(nodes[j])))
                roots[roots == roots[j]] = roots[i]
    return out


def _across(members: DataFrame) -> DataFrame:
    """(u, v) that join the groups within each (key, a, b) of the rows (key, a, b, node, root, own)."""

    def run(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint32) for x in group.column("own").to_pylist()]
        found = np.array(block_links(group.column("node").to_numpy(), group.column("root").to_numpy(), sets), np.int64).reshape(-1, 2)
        return pa.table({"u": found[:, 0], "v": found[:, 1]})

    return members.groupBy("key", "a", "b").applyInArrow(run, "u long, v long")


def _fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """(u, v) of nodes whose SimHash fingerprints link: one node a fingerprint beside the least node of each linked one."""
    fps = stored(simhash.fingerprints(texts, WORDS, "node").distinct(), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    alike = fps.join(least, "fp").select(F.col("node").alias("u"), F.col("doc_id").alias("v"))
    near = simhash.links(stored(least.select("fp"), "distinct"))
    far = near.join(least.select(F.col("fp").alias("u"), F.col("node").alias("a")), "u").join(least.select(F.col("fp").alias("v"), F.col("node").alias("b")), "v")
    return alike.unionByName(far.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))).where("u < v")


def groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, root) of every text of ``docs`` that is linked; node is its ``text_hash``."""
    texts = docs.select(text_hash().alias("node"), F.col("text").cast("string").alias("text"))
    keys = stored(_keys(texts), "band-keys")
    least = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    shared = stored(least.where("least < most").select("key", "least"), "shared-keys")
    members = stored(keys.join(shared, "key").select("key", "least", "node").distinct(), "members")
    banded = members.where("least < node").select(F.col("least").alias("u"), F.col("node").alias("v"))
    pairs = stored(banded.unionByName(_fingerprint_pairs(texts)).distinct(), "pairs")
    wanted = stored(members.select("node").union(pairs.select("u")).union(pairs.select("v")).distinct(), "wanted")
    # a text of many rows is hashed once for each, and one set of it stays
    sets = stored(_sets(texts.join(wanted, "node", "left_semi")).groupBy("node").agg(F.first("own").alias("own")), "sets")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
    links = stored(_verified(both.select("u", "v", "a", "b")), "links")
    roots = components(links)
    rooted = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    torn = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).where("least < most")
    torn = stored(torn.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "torn-keys")
    if torn.isEmpty():
        return roots
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, own).alias("a"), F.greatest(o, own).alias("b")))
    rows = rooted.join(torn, "key").join(sets, "node").withColumn("ab", F.explode(others))
    more = stored(_across(rows.select("key", "ab.a", "ab.b", "node", "root", "own")), "more-links")
    return components(links.unionByName(more))


def one_of_each(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of each group of near copies: the least doc_id, a row without one only where no other has one."""
    return one_row_each(docs, groups(docs, block))
