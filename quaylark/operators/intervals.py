"""Trees as preorder intervals: a subtree is a range of labels, so reading one needs no join.

Sizes go up the levels and starts come down them, a join a level. Siblings follow each
other in the order of (block, id), where the block is a hash of the id: running sums are
taken within blocks, then over a parent's at most ``BLOCKS`` blocks, so no task sorts all
children of a hot parent.

Null ids are dropped, equal rows count once, and a node with several parents keeps the least
one. A node whose parent is not in the table is a root. Nodes on cycles, or below ``max_hops``
levels, are reached from no root and have no label. An empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .hierarchy import MAX_HOPS

BLOCKS = 256


def _starts(nodes: DataFrame) -> DataFrame:
    """(id, first) of siblings (parent_id, id, size): sum of the sizes of those before a node."""
    dealt = nodes.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy("parent_id", "block").agg(F.sum("size").alias("of_block"))
    blocks = blocks.select("parent_id", "block", F.coalesce(F.sum("of_block").over(before("parent_id").orderBy("block")), F.lit(0)).alias("blocks_before"))
    rows = dealt.withColumn("in_block", F.coalesce(F.sum("size").over(before("parent_id", "block").orderBy("id")), F.lit(0)))
    met = rows.alias("r").join(blocks.alias("b"), F.expr("r.parent_id <=> b.parent_id AND r.block = b.block"))
    return met.select("r.id", "r.parent_id", "r.size", (F.col("in_block") + F.col("blocks_before")).alias("first"))


def labelled(edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(id, parent_id, depth, size, first, last): the subtree of a node is all rows with ``first`` between its first and last.

    ``edges`` is (id, parent_id); ``size`` counts the node itself. Rows come sorted by ``first``.
    """
    nodes = stored(edges.where("id IS NOT NULL").groupBy("id").agg(F.min("parent_id").alias("parent_id")), "tree-nodes")
    known = nodes.select(F.col("id").alias("parent_id"))
    level = stored(nodes.join(known, "parent_id", "left_anti").select("id", F.lit(None).cast(nodes.schema["parent_id"].dataType).alias("parent_id")), "tree-roots")
    levels = [level]
    for _ in range(max_hops):
        level = stored(nodes.join(level.select(F.col("id").alias("parent_id")), "parent_id").select("id", "parent_id"), "tree-level")
        if level.isEmpty():
            break
        levels.append(level)

    sized = [levels[-1].withColumn("size", F.lit(1).cast("long"))]
    for level in reversed(levels[:-1]):
        below = sized[0].groupBy("parent_id").agg(F.sum("size").alias("below")).withColumnRenamed("parent_id", "id")
        sized.insert(0, stored(level.join(below, "id", "left").select("id", "parent_id", (F.coalesce("below", F.lit(0)) + 1).alias("size")), "tree-sizes"))

    done: list[DataFrame] = []
    for depth, level in enumerate(sized):
        rows = _starts(level)
        if done:
            up = done[-1].select(F.col("id").alias("parent_id"), (F.col("first") + 1).alias("_from"))
            rows = rows.join(up, "parent_id").withColumn("first", F.col("first") + F.col("_from"))
        done.append(stored(rows.select("id", "parent_id", F.lit(depth).alias("depth"), "size", "first", (F.col("first") + F.col("size") - 1).alias("last")), "tree-labels"))
    return reduce(DataFrame.unionByName, done).repartitionByRange("first").sortWithinPartitions("first")


def subtree(labels: DataFrame, root: object) -> DataFrame:
    """Rows of a node and all below it, by one range filter; none where the node has no label.

    One row of two numbers goes to the driver, so that the range is literal, reaches the
    Parquet scan and skips files and row groups of a stored table of labels.
    """
    own = labels.where(F.col("id") == F.lit(root)).select("first", "last").first()
    return labels.where(F.col("first").between(own["first"], own["last"])) if own else labels.limit(0)


def subtrees(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, n): how many nodes lie in the subtree of each of ``roots`` (id), from the labels alone."""
    return roots.select("id").distinct().join(labels, "id").select(F.col("id").alias("root_id"), F.col("size").alias("n"))
