"""Prefix trie of conversations by preorder intervals.

Every distinct sequence of the first d turns of some conversations is a node of depth d. A
node is named by its depth and by two sums of hashes of its turns, each hashed with its place,
so that the names of all prefixes are running sums (``running_sums``) and no task holds a
whole conversation.

Preorder: of the children of a node the one with most members goes first, the others are
light. The rank of a node is the place of its key in lexicographic order; the key lists the
light nodes on its path (deepest branching first, then by smallest member) and ends with its
depth. A light node has at most half of its parent's members, so a key has at most log2 of
the number of conversations entries however long the conversations are. Each node sends two
rows into one sort, its key and the least key behind its subtree; the running sums of nodes,
leaves and savings at the two rows differ by the sums over the subtree, and the number of
nodes before the second row is the subtree's end position.

Scale: each step is a range sort with running sums, an aggregation with partial sums, or an
equi-join on both sides of which Spark may split skewed keys; a conversation or a node with
most rows is the work of many tasks. The digest of a node's ends is fed by runs of ids joined
where they were sorted.

Edge cases: turns go by turn (null first), then role, then text; null role or text is empty;
equal rows are as many turns; rows without conv_id belong to no conversation and are left
out; a conversation without turns ends at the root; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, stored
from .prefixsums import MASK, running_sums

#: Conversations c take up to ``SHARED`` - 1 first turns from conversation c - c % ``FAMILY``.
FAMILY, SHARED = 100, 6
_NODE = ["depth", "s1", "s2"]
_DEEPEST = 1 << 60
#: Copies of a row listed by one row when they are numbered; ids joined to one string.
_RUN, _JOINED = 4096, 4096


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, said, chars): the turns of each conversation by place from 1, ``said`` a digest of role and text."""
    empty = F.lit("")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text")
    )
    runs = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _RUN))))
    rows = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * _RUN, F.least(F.col("n"), (F.col("run") + 1) * _RUN) - 1)))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rows.select("conv_id", "turn", "role", "text", "copy", said.alias("said"), F.length("text").cast("long").alias("chars"), F.lit(1).cast("long").alias("pos"))
    return running_sums(rows, ["conv_id", "turn", "role", "text", "copy"], ["pos"], "conv_id", drop=("turn", "role", "text", "copy"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conv_ids, and (conv_id, depth, said, chars) of the rebuilt conversations of ``ordered_turns``.

    Conversation c has the first h turns of its family's first conversation (all if fewer), then
    its own turns after the first h; h = crc32 of the decimal conv_id modulo ``SHARED``.
    """
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    convs = stored(turns.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumn("shared", shared).withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY), "conversations")
    sizes = convs.select(F.col("conv_id").alias("first"), F.col("n").alias("n_first"))
    taken = convs.join(sizes, "first", "left").withColumn("taken", F.least("shared", F.coalesce("n_first", F.lit(0).cast("long"))))
    taken = stored(taken.select("conv_id", "first", "shared", "taken"), "taken-turns")
    short = taken.where("taken < shared").select("conv_id", (F.col("shared") - F.col("taken")).alias("lack"))
    own = turns.where(F.col("pos") > shared).join(short, "conv_id", "left").withColumn("depth", F.col("pos") - F.coalesce("lack", F.lit(0).cast("long")))
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < SHARED)).withColumnRenamed("conv_id", "first")
    given = taken.where("taken > 0").join(heads, "first").where("pos <= taken").withColumnRenamed("pos", "depth")
    columns = ["conv_id", "depth", "said", "chars"]
    return convs.select("conv_id"), own.select(*columns).unionByName(given.select(*columns))


def _lane(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, s1, s2, p1, p2, chars): the node of every turn, with the sums of its parent."""
    digest = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("said")), 256)
    marked = turns.select("conv_id", "depth", "chars", digest.alias("d")).select("conv_id", "depth", "chars", *[_lane(F.col("d"), at).alias(c) for c, at in (("s1", 1), ("s2", 16), ("l1", 1), ("l2", 16))])
    summed = running_sums(marked, ["conv_id", "depth"], ["s1", "s2"], "conv_id")
    parent = {f"p{i}": (F.col(f"s{i}") - F.col(f"l{i}")).bitwiseAND(F.lit(MASK)) for i in (1, 2)}
    return summed.select("conv_id", *_NODE, *[e.alias(c) for c, e in parent.items()], "chars")


def nodes_of(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """(depth, s1, s2, conv_id, n_convs, chars, parent_conv_id, light, n_children) of every distinct node."""
    zero = F.lit(0).cast("long")
    found = steps.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("s1"), zero.alias("s2"), "conv_id", "n_convs", zero.alias("chars"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes = stored(found.unionByName(root), "trie-nodes")
    least = F.min(F.struct((-F.col("n_convs")).alias("fewer"), "conv_id"))
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(F.count("*").alias("n_children"), least.alias("heavy"))
    above = stored(nodes.join(below, _NODE, "left").select(*_NODE, F.col("conv_id").alias("parent_conv_id"), F.col("heavy.conv_id").alias("heavy"), F.coalesce("n_children", zero).alias("n_children")), "trie-children")
    counted = nodes.join(above.select(*_NODE, "n_children"), _NODE)
    parents = above.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), "parent_conv_id", "heavy")
    joined = counted.join(parents, ["depth", "p1", "p2"], "left")
    light = F.coalesce(F.col("heavy") != F.col("conv_id"), F.lit(False))
    return stored(joined.select(*_NODE, "conv_id", "n_convs", "chars", "parent_conv_id", light.alias("light"), "n_children"), "trie")


def _hex(number: Column) -> Column:
    return F.lpad(F.hex(number), 16, "0")


def keyed(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """``nodes`` with ``key``, whose order is the preorder, and ``behind``, the least key after the subtree."""
    light = nodes.where("light").select(*_NODE, F.col("conv_id").alias("top"))
    hops = steps.join(light, _NODE).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "top"))).alias("hops"))
    both = nodes.join(hops, "conv_id", "left")
    on_path = F.filter(F.coalesce("hops", F.array().cast("array<struct<depth:bigint,top:bigint>>")), lambda x: x["depth"] <= F.col("depth"))
    turn = F.array_join(F.transform(on_path, lambda x: F.concat(F.lit("1"), _hex(F.lit(_DEEPEST) - x["depth"]), _hex(x["top"]))), "")
    both = both.withColumn("turns", turn).drop("hops")
    behind = F.concat("turns", F.lit("1"), _hex(F.lit(_DEEPEST - 1) - F.col("depth")), F.lit("g"))  # g: after all digits
    return both.withColumn("key", F.concat("turns", F.lit("0"), _hex(F.col("depth")))).withColumn("behind", behind).drop("turns")


def with_intervals(nodes: DataFrame) -> DataFrame:
    """Keyed nodes with their preorder ``rank`` (from 1), ``last`` (rank of the last node of the subtree), ``n_leaves`` and ``saved_tokens``."""
    leaf = (F.col("n_children") == 0).cast("long")
    saved = (F.col("n_convs") - 1) * F.col("chars")
    kept = ["conv_id", "depth", "s1", "s2", "n_convs", "parent_conv_id", "n_children"]
    zero = F.lit(0).cast("long")
    opening = nodes.select("key", F.lit(True).alias("opens"), *kept, F.lit(1).cast("long").alias("rank"), leaf.alias("leaves"), saved.alias("saved"), leaf.alias("own_leaf"), saved.alias("own_saved"))
    closing = nodes.select(F.col("behind").alias("key"), F.lit(False).alias("opens"), *[(F.col(c) if c in ("conv_id", "depth") else F.lit(None).cast("long")).alias(c) for c in kept], *[zero.alias(c) for c in ("rank", "leaves", "saved", "own_leaf", "own_saved")])
    summed = running_sums(opening.unionByName(closing), ["key"], ["rank", "leaves", "saved"], drop=("key",))
    at = {c: F.max(F.when(F.col("opens"), F.col(c))) for c in (*kept[2:], "rank", "leaves", "saved", "own_leaf", "own_saved")}
    ends = {f"last_{c}": F.max(F.when(~F.col("opens"), F.col(c))) for c in ("rank", "leaves", "saved")}
    pairs = summed.groupBy("conv_id", "depth").agg(*[e.alias(c) for c, e in (at | ends).items()])
    return pairs.select(
        *kept, "rank", F.col("last_rank").alias("last"), (F.col("last_leaves") - F.col("leaves") + F.col("own_leaf")).alias("n_leaves"), (F.col("last_saved") - F.col("saved") + F.col("own_saved")).alias("saved_tokens")
    )


def end_digests(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """(depth, s1, s2, ends_sha256) of the nodes at which conversations end: their ids in order, comma-joined."""
    zero = F.lit(0).cast("long")
    last = steps.groupBy("conv_id").agg(F.max(F.struct(*_NODE)).alias("node"))
    finals = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"node.{c}"), zero).alias(c) for c in _NODE])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            columns = [b.column(c).to_pylist() for c in (*_NODE, "conv_id")]
            out: list[tuple] = []
            for *node, conv in zip(*columns):
                if out and out[-1][0] == node and len(out[-1][2]) < _JOINED:
                    out[-1][2].append(str(conv))
                else:
                    out.append((node, conv, [str(conv)]))
            rows = [(*node, conv, ",".join(ids)) for node, conv, ids in out]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [*_NODE, "begin", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, hashlib.sha256()
        for b in batches:
            done = []
            for *own, ids in zip(*[b.column(c).to_pylist() for c in (*_NODE, "ids")]):
                if own != node:
                    if node:
                        done.append((*node, sha.hexdigest()))
                    node, sha = own, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield from _digests(done)
        if node:
            yield from _digests([(*node, sha.hexdigest())])

    order = [*_NODE, "conv_id"]
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = in_batches(finals.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*order), join, "depth long, s1 long, s2 long, begin long, ids string")
    runs = joined.repartition(parts, *_NODE).sortWithinPartitions(*_NODE, "begin")
    return in_batches(runs, digest, "depth long, s1 long, s2 long, ends_sha256 string")


def _digests(done: list[tuple]) -> Iterator[pa.RecordBatch]:
    if done:
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*done))[:3]), pa.array([d[3] for d in done])], [*_NODE, "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, rank, last, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(ordered_turns(conversations))
    steps = paths(turns)
    whole = with_intervals(keyed(nodes_of(convs, steps), steps))
    none = hashlib.sha256(b"").hexdigest()
    return whole.join(end_digests(convs, steps), _NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "rank", "last", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
