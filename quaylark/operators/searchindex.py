"""A stored search index that answers a whole table of searches by equi-joins.

Three tables lie under one path, each in folders by bucket of its join key:

* ``postings`` (token, key): the rows that hold a token, a frequent token in several files;
* ``prefixes`` (prefix, token): the first 1 to ``LONGEST_PREFIX`` letters of each distinct token;
* ``neighbours`` (variant, token): what tokens within one edit have in common.

Two strings within one edit become equal where each loses one letter or none, so tokens of
up to ``LONGEST_DELETED`` letters are stored under themselves and under all their forms that
lack one letter. Longer ones would have too many such forms, and one edit leaves their first
or their last ``EDGE`` letters as they are: they are stored under these two. Tokens of just
``LONGEST_DELETED`` letters have both, so that every pair shares a key. A candidate counts
only where its Levenshtein distance is one or less.

A search reads the buckets of its own prefixes and variants, never the names. Its words
match as in ``textsearch.matched``: exactly, as a prefix, or within one edit from
``LEAST_FUZZY`` letters on. Null or empty names have no tokens; null or empty searches give
no rows; equal rows give equal hits once for each key.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .textsearch import inverted_index, tokens

BUCKETS = 64
#: A frequent token's postings lie in up to as many files.
SPREAD = 16
LONGEST_PREFIX = 8
LONGEST_DELETED = 33
EDGE = 16
LEAST_FUZZY = 4


def variants(word: Column) -> Column:
    """Keys of which two strings within one edit share at least one."""
    n = F.length(word)
    shorter = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    deleted = F.when(n <= LONGEST_DELETED, F.array_distinct(F.concat(F.array(word), shorter)))
    edges = F.when(n >= LONGEST_DELETED, F.array(F.concat(F.lit("^"), F.left(word, F.lit(EDGE))), F.concat(F.lit("$"), F.right(word, F.lit(EDGE)))))
    none = F.array().cast("array<string>")
    return F.when(n > 0, F.concat(F.coalesce(deleted, none), F.coalesce(edges, none))).otherwise(none)


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class SearchIndex(NamedTuple):
    """Where an index lies; enough to open it in another session."""

    path: str
    key: str
    key_type: str = "bigint"
    buckets: int = BUCKETS

    def rows(self, spark: SparkSession, part: str, key: str, value: str, kind: str = "string") -> DataFrame:
        return spark.read.schema(f"{key} string, {value} {kind}, bucket int").parquet(f"{self.path}/{part}")


def _write(rows: DataFrame, key: str, index: SearchIndex, part: str, spread_by: str) -> None:
    """Folders by bucket of ``key``; the rows of one key may lie in ``SPREAD`` files, each sorted by it."""
    dealt = rows.withColumn("bucket", bucket(F.col(key), index.buckets)).repartition("bucket", F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)))
    dealt.sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/{part}")


def build(docs: DataFrame, key: str, text: str, path: str, buckets: int = BUCKETS) -> SearchIndex:
    """Write the three tables of the index of ``docs`` under ``path``."""
    spark = docs.sparkSession
    index = SearchIndex(path, key, docs.schema[key].dataType.simpleString(), buckets)
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    _write(inverted_index(named, "key", "text"), "token", index, "postings", "key")
    words = stored(index.rows(spark, "postings", "token", "key", index.key_type).select("token").distinct(), "index-words")
    first = F.sequence(F.lit(1), F.least(F.length("token"), F.lit(LONGEST_PREFIX)))
    _write(words.select(F.explode(F.transform(first, lambda n: F.left(F.col("token"), n))).alias("prefix"), "token"), "prefix", index, "prefixes", "token")
    _write(words.select(F.explode(variants(F.col("token"))).alias("variant"), "token"), "variant", index, "neighbours", "token")
    return index


def _met(words: DataFrame, key: str, index: SearchIndex, part: str, value: str, kind: str = "string") -> DataFrame:
    """Words joined with a table of the index on bucket and key, so that only their buckets are read."""
    return words.withColumn("bucket", bucket(F.col(key), index.buckets)).join(index.rows(words.sparkSession, part, key, value, kind), ["bucket", key])


def near(words: DataFrame, index: SearchIndex) -> DataFrame:
    """(word, token, edits): the index's tokens within one edit of each distinct ``word``; edits is 0 or 1."""
    return _within_one(_met(_keyed(words, "word"), "variant", index, "neighbours", "token"))


def near_all(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``near`` for so many words that most of an index would be read: both sides meet by their variants once, and nothing is stored.

    ``words`` is (word), ``vocabulary`` (token); repeated, null and empty ones count once or not at all.
    """
    return _within_one(_keyed(words, "word").join(_keyed(vocabulary, "token"), "variant"))


def _keyed(words: DataFrame, name: str) -> DataFrame:
    """(name, variant) of distinct words."""
    return words.select(name).where(F.length(name) > 0).distinct().select(name, F.explode(variants(F.col(name))).alias("variant"))


def _within_one(pairs: DataFrame) -> DataFrame:
    """Candidates, which may share several variants, within one edit: (word, token, edits) once each."""
    return pairs.select("word", "token", F.levenshtein("word", "token", 1).alias("edits")).where("edits >= 0").distinct()


def starting(words: DataFrame, index: SearchIndex) -> DataFrame:
    """(word, token): the index's tokens that start with each distinct ``word``."""
    short = F.col("word") != ""
    keyed = words.select("word").where(short).distinct().withColumn("prefix", F.left("word", F.lit(LONGEST_PREFIX)))
    return _met(keyed, "prefix", index, "prefixes", "token").where(F.startswith("token", "word")).select("word", "token")


def answers(searches: DataFrame, search: str, index: SearchIndex) -> DataFrame:
    """(search, key, matched, edits, exact) of every distinct text of ``searches``: the score of ``textsearch.matched``.

    Words resolve to tokens first, each distinct word once, then tokens meet their postings.
    """
    asked = searches.select(F.col(search).alias("search")).distinct().select("search", F.posexplode(tokens(F.col("search"))).alias("at", "word"))
    words = asked.select("word").distinct()
    fuzzy = near(words.where(F.length("word") >= LEAST_FUZZY), index)
    both = starting(words, index).withColumn("edits", F.lit(0)).unionByName(fuzzy)
    resolved = both.groupBy("word", "token").agg(F.min("edits").alias("edits"))
    wanted = asked.join(resolved, "word").withColumn("exact", (F.col("word") == F.col("token")).cast("int"))
    hits = _met(wanted, "token", index, "postings", "key", index.key_type)
    best = hits.groupBy("search", "key", "at").agg(F.min("edits").alias("edits"), F.max("exact").alias("exact"))
    scored = best.groupBy("search", "key").agg(F.count("*").alias("matched"), F.sum("edits").alias("edits"), F.sum("exact").alias("exact"))
    return scored.select(F.col("search").alias(search), F.col("key").alias(index.key), "matched", "edits", "exact")
