"""Trees kept as parent edges: closures, descendants, roll-ups, locale preference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

MAX_HOPS = 20


def closure(edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(id, ancestor_id, depth) of every node, itself at depth 0; cycles end at ``max_hops``.

    One join a level of the tree, each level written to the shared folder: a recursive
    table expression would stop at Spark's limit of rows. ``edges`` is (id, parent_id).
    """
    up = edges.select(F.col("id").alias("ancestor_id"), F.col("parent_id").alias("next")).where("next IS NOT NULL")
    level = edges.select("id", F.col("id").alias("ancestor_id"), F.lit(0).alias("depth"))
    levels = [level]
    for depth in range(1, max_hops + 1):
        higher = level.join(up, "ancestor_id").select("id", F.col("next").alias("ancestor_id"), F.lit(depth).alias("depth"))
        level = stored(higher, "tree-level")
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def root_path(edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(id, path): ids from the root down to the node itself."""
    steps = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), F.col("ancestor_id").alias("a"))))
    return closure(edges, max_hops).groupBy("id").agg(F.transform(steps, lambda s: s["a"]).alias("path"))


def descendants(edges: DataFrame, root: int) -> DataFrame:
    """Ids of a node and of everything below it."""
    return closure(edges).where(F.col("ancestor_id") == root).select("id")


def expanded(direct: Column, ancestors: Column) -> Column:
    """Direct ids first, in their order, then the other ancestors sorted."""
    return F.concat(direct, F.array_sort(F.array_except(ancestors, direct)))


def prefer_locale(names: DataFrame, key: str, locale: str, order: Column) -> DataFrame:
    """One row a key: the preferred locale, else English, else the first in order."""
    rank = F.when(F.col("locale") == locale, 0).when(F.col("locale") == "en", 1).otherwise(2)
    w = Window.partitionBy(key).orderBy(rank, order)
    return names.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def unique_slug(slug: Column, longer: Column, longest: Column) -> Column:
    """The shortest form that only one row has: windows count the rows of each form."""
    alone = lambda c: F.count("*").over(Window.partitionBy(c)) == 1
    return F.when(alone(slug), slug).when(alone(longer), longer).otherwise(longest)
