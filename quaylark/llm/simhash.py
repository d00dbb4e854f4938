"""SimHash fingerprints and exact linking of fingerprints that differ in few bits.

Linking follows the generalised pigeonhole principle. The 64 bits are dealt to m
partitions, correlated bits together; partition i gets a threshold t_i (-1: not
probed) with sum(t_i) = d - m + 1, where d is the largest distance that links. Two
fingerprints within d then differ in at most t_i bits of some partition i. The
thresholds (and m) are chosen by dynamic programming on estimated costs: rows
emitted and candidate pairs, from counts over all fingerprints.

Probing: in partition i a fingerprint emits its own bits with up to t_i of the set
bits cleared. Two values within t_i of each other share one of these keys (clear in
each what the other lacks). All who share a key are verified on all 64 bits. A key
yields links that span its linked members (each pair is compared, a spanning set is
kept), so its output grows with its members and not with their pairs. Keys of more
than ``KEY_ROWS`` members are dealt to blocks and each pair of blocks is compared in
a task of its own, so no key is gathered whole.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like
any other; fewer words than a shingle make one shingle of all words; repeated texts
and rows share a fingerprint; rows without doc_id keep a row and name no component.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, one_row_each, slices, stored, text_hash, texts_of, wider
from .components import components

WORDS, DISTANCE, SEED = 4, 4, 42
#: Members of one key that one task compares; larger keys are compared block by block.
KEY_ROWS = 8192
#: Keys of more than KEY_ROWS members that are sent to all tasks; beyond, they are joined.
HOT_KEYS = 100_000
#: Relative costs of an emitted row and of a compared pair.
ROW_COST, PAIR_COST = 20.0, 1.0


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of a text, as a signed integer."""
    parts = text.encode().lower().split()  # on bytes: only A-Z, only ASCII white space
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    k = min(words, len(parts))
    edges = zip((ends - sizes)[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist())
    h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in edges], "<u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_in_most = bits.sum(axis=0, dtype=np.int64) * 2 > len(h)
    return int(np.packbits(set_in_most, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = pa.array([fingerprint(t, words) for t in texts_of(b)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), fps], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows, run, f"doc_id {kind}, fp long")


# --- partitions and thresholds ---------------------------------------------


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits i and j (64 x 64), over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for b in batches:
            x = b.column("fp").to_numpy().astype("<i8")
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel().astype(np.int64))], ["cell", "n"])

    cells = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4096 rows
    grid = np.zeros(4096)
    for r in cells:
        grid[r["cell"]] = r["n"]
    return fps.count(), grid.reshape(64, 64)


def correlated_partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Deal 64 bits to m partitions of about equal width, each with bits that are correlated."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        own = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(own[0])
        while len(own) < width:
            best = max(sorted(free), key=lambda b: corr[b, own].sum())
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def mask_of(bits: list[int]) -> int:
    """The bits as a signed 64-bit mask."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def pairs_within(n: int, p: np.ndarray, same: float, most: int) -> list[float]:
    """Estimated pairs that differ in at most t = 0..most bits of a partition.

    ``same`` is the exact number of pairs that agree; the growth from t = 0 follows
    from the share of ones of each bit.
    """
    differ = 2 * p * (1 - p)
    dist = np.zeros(most + 1)
    dist[0] = 1.0
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    base = max(same, n * (n - 1) / 2 * dist[0], 1e-9)
    return (base * np.cumsum(dist) / max(dist[0], 1e-30)).tolist()


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 or more) that sum to ``total`` at the least cost; costs[i][t] for t >= 0."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t in range(-1, len(own)):
                found = (cost + (own[t] if t >= 0 else 0.0), [*chosen, t])
                if s + t not in step or found < step[s + t]:
                    step[s + t] = found
        best = step
    return best[total]


def plan(fps: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, for the distinct fingerprints ``fps`` (fp)."""
    n, both = bit_counts(fps)
    p = np.diag(both) / max(n, 1)
    ways = {m: correlated_partitions(n, both, m) for m in range(2, distance + 2)}
    masks = [(m, i, mask_of(bits)) for m, parts in ways.items() for i, bits in enumerate(parts)]
    values = fps.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(k)) for _, _, k in masks])).alias("way", "value"))
    same = {r["way"]: float(r["same"]) for r in values.groupBy("way", "value").count().groupBy("way").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("same")).collect()}  # a row a mask
    best = None
    for m, parts in ways.items():
        costs = []
        for i, bits in enumerate(parts):
            ones = round(float(p[bits].sum()))
            most = distance - m + 1 + (m - 1)
            pairs = pairs_within(n, p[bits], same.get([x[:2] for x in masks].index((m, i)), 0.0), most)
            rows = np.cumsum([comb(max(ones, 1), t) for t in range(most + 1)])
            probes = np.cumsum([comb(len(bits), t) for t in range(most + 1)])
            costs.append([ROW_COST * n * float(rows[t]) + PAIR_COST * pairs[t] for t in range(most + 1) if probes[t] <= 5000])
        cost, chosen = allocate(costs, distance - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(parts, chosen) if t >= 0])
    return best[1]


# --- probing and verifying --------------------------------------------------


def _clears(bits: list[int], most: int) -> list[int]:
    return [~mask_of(list(c)) for t in range(most + 1) for c in combinations(bits, t)]


def _numbered(keys: Column, part: int) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(part).alias("part"), k.alias("key")))


def keys_of(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp): in each partition the bits of fp with up to t set bits cleared."""
    each = []
    for i, (bits, t) in enumerate(parts):
        own = F.col("fp").bitwiseAND(F.lit(mask_of(bits)))
        cleared = F.array_distinct(F.array(*[own.bitwiseAND(F.lit(c)) for c in _clears(bits, t)]))
        each.append(_numbered(cleared, i))
    return fps.select(F.explode(F.concat(*each)).alias("k"), "fp").select("k.part", "k.key", "fp")


def spanning_links(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links from the least member of each linked set of ``fp`` to its other members."""
    rest, out = np.sort(fp), []
    while len(rest):
        seed, rest = rest[0], rest[1:]
        front = [seed]
        while front and len(rest):
            near = np.bitwise_count((rest ^ front.pop()).view(np.uint64)) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                front.extend(found)
                out.extend((int(seed), int(x)) for x in found)
    return out


def verified(groups: DataFrame, distance: int) -> DataFrame:
    """(u, v) that span the linked members of each key; rows come sorted by (part, key, a, b)."""

    def links(g: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.diff(g)) + 1
        starts, sizes = np.concatenate([[0], edge]), np.diff(np.concatenate([[0], edge, [len(g)]]))
        us, vs = [], []
        small = np.repeat(sizes <= 16, sizes)
        for lag in range(1, int(min(16, sizes.max(initial=1)))):
            i = np.flatnonzero((g[lag:] == g[:-lag]) & small[lag:])
            i = i[np.bitwise_count((fp[i] ^ fp[i + lag]).view(np.uint64)) <= distance]
            us.append(fp[i])
            vs.append(fp[i + lag])
        for s, n in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist()):
            found = np.array(spanning_links(np.unique(fp[s : s + n]), distance), np.int64).reshape(-1, 2)
            us.append(found[:, 0])
            vs.append(found[:, 1])
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: tuple[np.ndarray, ...] | None = None
        number = 0
        for b in wider(batches):
            cols = [b.column(c).to_numpy() for c in ("part", "key", "a", "b", "fp")]
            if left is not None:
                cols = [np.concatenate(x) for x in zip(left, cols)]
            new = np.zeros(len(cols[0]), bool)
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            number = np.cumsum(new)
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if cut:
                yield from links(number[:cut], cols[4][:cut])
            left = tuple(c[cut:] for c in cols)
        if left is not None and len(left[0]):
            yield from links(np.zeros(len(left[0]), np.int64), left[4])

    return groups.mapInArrow(run, "u long, v long").where("u != v")


def links(fps: DataFrame, distance: int = DISTANCE, key_rows: int = KEY_ROWS) -> DataFrame:
    """(u, v): links whose components are those of all pairs of ``fps`` (distinct fp) within ``distance``."""
    keys = keys_of(fps, plan(fps, distance))
    hot = stored(keys.groupBy("part", "key").count().where(F.col("count") > key_rows), "hot-keys")
    n_hot = hot.count()
    if n_hot:
        hot = hot.select("part", "key", F.ceil(F.col("count") / key_rows).cast("int").alias("blocks"))
        keys = keys.join(F.broadcast(hot) if n_hot <= HOT_KEYS else hot, ["part", "key"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, own).alias("a"), F.greatest(o, own).alias("b")))
        plain = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
        keys = keys.withColumn("ab", F.explode(F.when(F.col("blocks").isNull(), plain).otherwise(others))).select("part", "key", "ab.a", "ab.b", "fp")
    else:
        keys = keys.select("part", "key", F.lit(0).alias("a"), F.lit(0).alias("b"), "fp")
    order = ["part", "key", "a", "b"]
    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return verified(keys.repartition(width, *order).sortWithinPartitions(*order, "fp"), distance)


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", key_rows: int = KEY_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id, group_size): component_id is the least doc_id reachable over links."""
    fps = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), distance, key_rows))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"))
    classes = rooted.select("fp", "root").join(groups, "root").select("fp", "component_id", "group_size")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(classes, "fp").select("doc_id", hexed, "component_id", "group_size")


def one_of_each(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, key_rows: int = KEY_ROWS) -> DataFrame:
    """One row of each group of linked texts of ``docs``: the least doc_id, a row without one only where no other has one."""
    fps = stored(fingerprints(docs.select(text_hash().alias("node"), "text"), words, "node").distinct(), "fingerprints")
    roots = components(links(stored(fps.select("fp").distinct(), "distinct"), distance, key_rows))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return one_row_each(docs, rooted.select(F.col("doc_id").alias("node"), F.coalesce("root", "fp").alias("root")))
