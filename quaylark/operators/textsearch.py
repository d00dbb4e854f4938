"""Keyword search and typeahead over short names: inverted index, scores, suggestions.

Score of a hit, in this order: matched tokens, fewer edits, exact prefix; ties go to the
newer and then to the lesser id. A token matches exactly, as a prefix, or within one
edit (tokens of four letters or more, and only where no exact or prefix match exists).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case tokens; + # and . belong to a token, - and / part it."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}+#.]+", " "), " "), lambda t: t != "")


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key): each token of a row once."""
    return docs.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))


def matched(index: DataFrame, key: str, words: Sequence[str], typos: bool = True) -> DataFrame:
    """(key, matched, edits, exact) of rows of the index that match a word."""
    tests = []
    for i, word in enumerate(words):
        exact, prefix = F.col("token") == word, F.startswith(F.col("token"), F.lit(word))
        # one edit moves the length by one at most, which spares most comparisons
        near = (F.abs(F.length("token") - len(word)) <= 1) & (F.levenshtein(F.col("token"), F.lit(word), 1) == 1) if typos and len(word) >= 4 else F.lit(False)
        tests.append(F.when(exact | prefix | near, F.struct(F.lit(i).alias("word"), F.when(exact | prefix, 0).otherwise(1).alias("edits"), exact.cast("int").alias("exact"))))
    hits = index.select(key, F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("hit")).select(key, "hit.*")  # one scan, whatever the words
    best = hits.groupBy(key, "word").agg(F.min("edits").alias("edits"), F.max("exact").alias("exact"))
    return best.groupBy(key).agg(F.count("*").alias("matched"), F.sum("edits").alias("edits"), F.sum("exact").alias("exact"))


def most_words(hits: DataFrame) -> DataFrame:
    """Hits of ``matched`` with as many words as any hit has: words that nothing matches beside the others are dropped."""
    return hits.join(F.broadcast(hits.agg(F.max("matched").alias("matched"))), "matched")  # one row


def suggest(names: DataFrame, key: str, name: str, typed: str, weight: str, k: int) -> DataFrame:
    """Typeahead: a token starts with what was typed; heavier names first."""
    low = typed.lower()
    hit = F.exists(tokens(F.col(name)), lambda t: F.startswith(t, F.lit(low)))
    start = F.startswith(F.lower(name), F.lit(low))
    return names.where(hit).orderBy(start.desc(), F.desc(weight), key).limit(k)


def boosted(ranked: DataFrame, favoured: DataFrame, key: str, rank: str) -> DataFrame:
    """Rows with a favoured key first; both parts keep their order."""
    flag = favoured.select(key).distinct().withColumn("_on", F.lit(True))
    both = ranked.join(flag, key, "left")
    return both.orderBy(F.coalesce("_on", F.lit(False)).desc(), rank).drop("_on")


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of letter trigrams."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return F.lit(12742.0) * F.asin(F.sqrt(a))


def field_weight(hits: Sequence[tuple[Column, int]]) -> Column:
    """The greatest weight of the fields that match; 0 where none does."""
    return F.greatest(F.lit(0), *[F.when(hit, weight).otherwise(0) for hit, weight in hits])


def in_language(hits: DataFrame, locale: str, wanted: str) -> DataFrame:
    """Hits in the wanted language; all English ones where it has none."""
    own = hits.where(F.col(locale) == wanted)
    there = own.limit(1).select(F.lit(True).alias("_there"))
    english = hits.where(F.col(locale) == "en").join(there, F.lit(True), "left_anti")
    return own.unionByName(english)


def numbered_top(df: DataFrame, order: Sequence[Column], k: int, alias: str = "place") -> DataFrame:
    """The first k rows with their place; only these are numbered in one task."""
    from pyspark.sql import Window

    return df.orderBy(*order).limit(k).withColumn(alias, F.row_number().over(Window.orderBy(*order)))


def parsed(queries: DataFrame, key: str, text: str, terms: DataFrame, most_words: int = 3) -> DataFrame:
    """(key, filters map<kind, values>, keywords) of free-text queries; terms is (term, kind, value).

    Runs of up to ``most_words`` tokens meet the dictionary in one join. Of terms that
    overlap in a query the longest stays, of equally long ones the first; words that belong
    to none are keywords, in their order.

    The dictionary goes to the tasks and the queries never do, however small Spark takes them
    for: it reckons with the size of their files, not with that of their runs.
    """
    words = queries.select(key, tokens(F.col(text)).alias("w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most_words)), lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("w", i + 1, n), " ").alias("term")))))
    found = words.select(key, F.explode(runs).alias("r")).select(key, "r.*").join(F.broadcast(terms), "term").select(key, F.struct((-F.col("n")).alias("short"), "at", "n", "kind", "value").alias("m"))
    best = found.groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("all"))  # as many as a query has words
    free = lambda acc, m: ~F.exists(acc, lambda x: (x["at"] < m["at"] + m["n"]) & (m["at"] < x["at"] + x["n"]))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, m: F.when(free(acc, m), F.concat(acc, F.array(m))).otherwise(acc))
    rows = words.join(best.hint("merge"), key, "left").withColumn("kept", F.coalesce(kept, F.array().cast("array<struct<short:int,at:int,n:int,kind:string,value:string>>")))
    kinds = F.array_sort(F.array_distinct(F.transform("kept", lambda m: m["kind"])))
    filters = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.array_distinct(F.transform(F.array_sort(F.filter(F.transform("kept", lambda m: F.struct(m["at"], m["kind"], m["value"])), lambda m: m["kind"] == k)), lambda m: m["value"])))))
    rest = F.filter(F.transform("w", lambda w, i: F.when(~F.exists("kept", lambda m: (m["at"] <= i) & (i < m["at"] + m["n"])), w)), lambda w: w.isNotNull())
    return rows.select(key, filters.alias("filters"), rest.alias("keywords"))
