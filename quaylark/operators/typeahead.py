"""Typeahead from stored lists: the best names of each prefix, kept up by slices of changes.

Three tables lie under one path, in folders ``gen=G/bucket=B``; ``manifest/gen=G`` names the
folders that count:

* ``names`` (key, name, weight) by bucket of the key: what a key had before a change;
* ``entries`` (prefix, key, starts, weight, name) by bucket of the prefix: all names of a prefix;
* ``lists`` (prefix, place, key, name, weight) by bucket of the prefix: the first ``k`` of them.

A slice of changes rewrites the buckets of the prefixes that its old and new names have, and
links the others to the folders they had; prefixes that no change touches keep their lists. The
manifest is written last, so a slice that fails leaves the index as it was, and a slice that
is applied again gives the same index.

Order in a list: names that begin with what was typed, greater weights, lesser keys; null
weights come last. A name with several words of one prefix is there once. Null keys are dropped,
null and empty names have no prefixes; of rows with one key the last by (removed, weight, name)
counts, nulls least. What was typed beyond ``LONGEST`` letters is looked up in the entries of
its first letters.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .searchindex import bucket
from .textsearch import tokens

LONGEST = 8
#: A frequent prefix's entries lie in up to as many files of a bucket.
SPREAD = 16
PARTS = ("names", "entries", "lists")


class Typeahead(NamedTuple):
    """Where an index lies, the type of its keys, and its size."""

    path: str
    key_type: str = "bigint"
    k: int = 10
    buckets: int = 64

    def generation(self, spark: SparkSession) -> int:
        """The newest complete generation."""
        return spark.read.schema("part string, bucket int, in_gen int, gen int").parquet(f"{self.path}/manifest").agg(F.max("gen")).first()[0]

    def folders(self, spark: SparkSession, part: str, gen: int) -> DataFrame:
        """(gen, bucket) of the folders of a part that count in a generation; a row a bucket at most."""
        rows = spark.read.schema("part string, bucket int, in_gen int").parquet(f"{self.path}/manifest/gen={gen}")
        return rows.where(F.col("part") == part).select(F.col("in_gen").alias("gen"), "bucket")

    def rows(self, spark: SparkSession, part: str, gen: int) -> DataFrame:
        """A part as of a generation; the join with its folders prunes all others."""
        schema = {
            "names": f"key {self.key_type}, name string, weight double",
            "entries": f"prefix string, key {self.key_type}, starts boolean, weight double, name string",
            "lists": f"prefix string, place int, key {self.key_type}, name string, weight double",
        }[part]
        all_rows = spark.read.schema(f"{schema}, gen int, bucket int").parquet(f"{self.path}/{part}")
        return all_rows.join(F.broadcast(self.folders(spark, part, gen)), ["gen", "bucket"], "left_semi").drop("gen")


def _latest(rows: DataFrame, key: str, name: str, weight: str, removed: Column) -> DataFrame:
    """(key, name, weight, removed), a row a key."""
    named = rows.select(F.col(key).alias("key"), removed.alias("removed"), F.col(weight).cast("double").alias("weight"), F.col(name).alias("name"))
    last = named.where("key IS NOT NULL").groupBy("key").agg(F.max(F.struct("removed", "weight", "name")).alias("r"))
    return last.select("key", "r.name", "r.weight", "r.removed")


def _entries(names: DataFrame) -> DataFrame:
    """(prefix, key, starts, weight, name) of all prefixes of a name's words."""
    of_word = lambda t: F.transform(F.sequence(F.lit(1), F.least(F.length(t), F.lit(LONGEST))), lambda n: F.left(t, n))
    each = names.select("key", "name", "weight", F.explode(F.array_distinct(F.flatten(F.transform(tokens(F.col("name")), of_word)))).alias("prefix"))
    return each.select("prefix", "key", F.startswith(F.lower("name"), "prefix").alias("starts"), "weight", "name")


def _lists(entries: DataFrame, k: int) -> DataFrame:
    """The first ``k`` entries of each prefix; each task drops what cannot be among them before the shuffle."""
    order = Window.partitionBy("prefix").orderBy(F.desc("starts"), F.desc_nulls_last("weight"), "key")
    return entries.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("prefix", "place", "key", "name", "weight")


def _write(rows: DataFrame, index: Typeahead, part: str, gen: int) -> None:
    by = "key" if part == "names" else "prefix"
    dealt = rows.withColumn("bucket", bucket(F.col(by), index.buckets)).repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SPREAD)))
    dealt.sortWithinPartitions("bucket", by).write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/{part}/gen={gen}")


def _commit(spark: SparkSession, index: Typeahead, gen: int, touched: dict[str, DataFrame] | None) -> None:
    """Write the manifest: touched buckets (all where None) lie in this generation, the others where they lay."""
    manifest = None
    for part in PARTS:
        every = spark.range(index.buckets).select(F.col("id").cast("int").alias("bucket"))
        if touched is None:
            rows = every.withColumn("in_gen", F.lit(gen))
        else:
            new = touched[part].select("bucket").distinct().withColumn("in_gen", F.lit(gen))
            old = index.folders(spark, part, gen - 1).withColumnRenamed("gen", "in_gen").select("bucket", "in_gen")
            rows = new.unionByName(old.join(new, "bucket", "left_anti"))
        rows = rows.select(F.lit(part).alias("part"), "bucket", "in_gen")
        manifest = rows if manifest is None else manifest.unionByName(rows)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{index.path}/manifest/gen={gen}")  # three rows a bucket


def build(rows: DataFrame, key: str, name: str, weight: str, path: str, k: int = 10, buckets: int = 64) -> Typeahead:
    """Write an index of ``rows`` under a path that holds none."""
    spark = rows.sparkSession
    index = Typeahead(path, rows.schema[key].dataType.simpleString(), k, buckets)
    _write(_latest(rows, key, name, weight, F.lit(False)).drop("removed"), index, "names", 0)
    names = spark.read.schema(f"key {index.key_type}, name string, weight double").parquet(f"{path}/names/gen=0")
    _write(_entries(names), index, "entries", 0)
    entries = spark.read.schema(f"prefix string, key {index.key_type}, starts boolean, weight double, name string").parquet(f"{path}/entries/gen=0")
    _write(_lists(entries, k), index, "lists", 0)
    _commit(spark, index, 0, None)
    return index


def apply(index: Typeahead, changes: DataFrame, key: str, name: str, weight: str, removed: Column, gen: int | None = None) -> int:
    """Apply a slice of changes to generation ``gen`` (the newest) and return the new one.

    A row whose ``removed`` holds takes its key out; any other puts its key in or anew.
    """
    spark = changes.sparkSession
    at = index.generation(spark) if gen is None else gen
    path, new_gen = index.path, at + 1
    # the slice is stored first: it is read several times, and its rows must not change between
    _latest(changes, key, name, weight, F.coalesce(removed, F.lit(False))).write.mode("overwrite").parquet(f"{path}/changes/gen={new_gen}")
    slice_ = spark.read.schema(f"key {index.key_type}, name string, weight double, removed boolean").parquet(f"{path}/changes/gen={new_gen}")
    fresh = slice_.where("NOT removed").drop("removed")
    keys = slice_.select("key", bucket(F.col("key"), index.buckets).alias("bucket"))
    old_names = index.rows(spark, "names", at)
    before = old_names.join(keys, ["bucket", "key"], "left_semi").drop("bucket")
    _entries(before).unionByName(_entries(fresh)).select("prefix").distinct().write.mode("overwrite").parquet(f"{path}/touched/gen={new_gen}")
    prefixes = spark.read.schema("prefix string").parquet(f"{path}/touched/gen={new_gen}")
    buckets = prefixes.select(bucket(F.col("prefix"), index.buckets).alias("bucket")).distinct()
    key_buckets = keys.select("bucket").distinct()

    in_buckets = lambda rows, those: rows.join(F.broadcast(those), "bucket", "left_semi").drop("bucket")  # noqa: E731  (a row a bucket)
    _write(in_buckets(old_names, key_buckets).join(slice_.select("key"), "key", "left_anti").unionByName(fresh), index, "names", new_gen)
    kept = in_buckets(index.rows(spark, "entries", at), buckets).join(slice_.select("key"), "key", "left_anti")
    _write(kept.select("prefix", "key", "starts", "weight", "name").unionByName(_entries(fresh)), index, "entries", new_gen)
    entries = spark.read.schema(f"prefix string, key {index.key_type}, starts boolean, weight double, name string").parquet(f"{path}/entries/gen={new_gen}")
    same = in_buckets(index.rows(spark, "lists", at), buckets).join(prefixes, "prefix", "left_anti")
    _write(same.unionByName(_lists(entries.join(prefixes, "prefix", "left_semi"), index.k)), index, "lists", new_gen)
    _commit(spark, index, new_gen, {"names": key_buckets, "entries": buckets, "lists": buckets})
    return new_gen


def lists(spark: SparkSession, index: Typeahead) -> DataFrame:
    """All lists: (prefix, place, key, name, weight)."""
    return index.rows(spark, "lists", index.generation(spark)).select("prefix", "place", "key", "name", "weight")


def suggest(spark: SparkSession, index: Typeahead, typed: str) -> DataFrame:
    """(place, key, name, weight) of what was typed: reads one bucket; nothing typed gives no rows."""
    low, gen = typed.lower(), index.generation(spark)
    prefix = F.lit(low[:LONGEST])
    part = "lists" if len(low) <= LONGEST else "entries"
    rows = index.rows(spark, part, gen).where((F.col("prefix") == prefix) & (F.col("bucket") == bucket(prefix, index.buckets)))
    if part == "entries":
        hit = rows.where(F.exists(tokens(F.col("name")), lambda t: F.startswith(t, F.lit(low))))
        rows = _lists(hit.withColumns({"starts": F.startswith(F.lower("name"), F.lit(low)), "prefix": F.lit(low)}), index.k)
    return rows.select("place", "key", "name", "weight").orderBy("place")
