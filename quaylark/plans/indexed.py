"""Queries that read stored indexes: searches by equi-joins, typeahead lists, subtrees by ranges, digest trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digesttree, intervals, searchindex, textsearch, typeahead
from ..registry import query
from ..storage import fresh_path, stored
from ..tables import POSTINGS, postings, table
from .relations import _CLOSURE, _edges, _remote

_WORDS = r"list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}+#.]+', ' ', 'g'), ' '), lambda t: t <> '')"

#: Within one edit: equal up to some place, and from there on but for a letter of either or both. An edit leaves one half of a word as it is.
_ONE_EDIT = """len(list_filter(range(0, least(length(w), length(t)) + 1), lambda i: left(w, i::INTEGER) = left(t, i::INTEGER) AND
 (substr(w, i + 2) = substr(t, i + 2) OR substr(w, i + 2) = substr(t, i + 1) OR substr(w, i + 1) = substr(t, i + 2)))) > 0"""


@query(f"""
WITH v AS (SELECT DISTINCT unnest({_WORDS}) AS t FROM documents), s AS (SELECT DISTINCT unnest({_WORDS}) AS w FROM documents WHERE doc_id % 20 = 0),
q AS (SELECT w, length(w) // 2 AS h FROM s WHERE length(w) >= 4), e AS (SELECT t, unnest(range(2, length(t) + 1)) AS h FROM v),
c AS (SELECT w, t FROM q JOIN e ON q.h = e.h AND left(w, q.h::INTEGER) = left(t, e.h::INTEGER)
 UNION SELECT w, t FROM q JOIN e ON length(w) - q.h = e.h AND right(w, (length(w) - q.h)::INTEGER) = right(t, e.h::INTEGER))
SELECT w AS word, t AS token, CASE WHEN w = t THEN 0 ELSE 1 END AS edits FROM c WHERE abs(length(w) - length(t)) <= 1 AND {_ONE_EDIT}""")
def txt_02_near_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-02: words of every twentieth document against the words of all documents, within one edit."""
    docs = table(spark, sf_dir, "documents")
    words = lambda rows, name: rows.select(F.explode(F.array_distinct(textsearch.tokens(F.col("text")))).alias(name))
    asked = words(docs.where("doc_id % 20 = 0"), "word").where(F.length("word") >= searchindex.LEAST_FUZZY)
    return searchindex.near_all(asked, words(docs, "token"))


@query("""
WITH i AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS token FROM part),
s AS (SELECT DISTINCT left(p_name, 2) || substr(p_name, 4) AS search FROM part WHERE p_partkey % 20 = 0),
w AS (SELECT search, unnest(string_split(search, ' ')) AS word, generate_subscripts(string_split(search, ' '), 1) AS pos FROM s),
h AS (SELECT search, p_partkey, pos, min(CASE WHEN starts_with(token, word) THEN 0 ELSE 1 END) AS edits, max((token = word)::INTEGER) AS exact FROM w, i
 WHERE word <> '' AND (starts_with(token, word) OR (length(word) >= 4 AND levenshtein(token, word) <= 1)) GROUP BY 1, 2, 3)
SELECT search, p_partkey, count(*) AS matched, sum(edits)::BIGINT AS edits, sum(exact)::BIGINT AS exact FROM h GROUP BY 1, 2""")
def txt_01_search_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-01/02/03: a table of searches at once; here names of every twentieth part that lack their third letter, against all parts."""
    part = table(spark, sf_dir, "part")
    index = searchindex.build(part, "p_partkey", "p_name", fresh_path(spark, "search-index"))
    searches = part.where("p_partkey % 20 = 0").select(F.concat(F.left("p_name", F.lit(2)), F.substr("p_name", F.lit(4))).alias("search"))
    return searchindex.answers(searches, "search", index)


@query("""
WITH f AS (SELECT p_partkey AS key, p_name AS name, (p_size + CASE WHEN p_brand LIKE 'Brand#1%' THEN 100 ELSE 0 END)::DOUBLE AS weight FROM part WHERE p_type NOT LIKE 'PROMO%'),
w AS (SELECT key, name, weight, unnest(string_split(name, ' ')) AS t FROM f), p AS (SELECT DISTINCT key, name, weight, left(t, unnest(range(1, least(length(t), 8) + 1))::INTEGER) AS prefix FROM w WHERE t <> '')
SELECT prefix, place::INTEGER AS place, key, name, weight FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY starts_with(name, prefix) DESC, weight DESC, key) AS place FROM p) WHERE place <= 10""")
def txt_07_typeahead_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-03/07/09/11: best ten names of each prefix, after a slice that takes some names out and moves others up."""
    part = table(spark, sf_dir, "part")
    index = typeahead.build(part, "p_partkey", "p_name", "p_size", fresh_path(spark, "typeahead"))
    out, up = F.col("p_type").startswith("PROMO"), F.col("p_brand").startswith("Brand#1")
    slice_ = part.where(out | up).withColumns({"out": out, "p_size": F.col("p_size") + F.when(up, 100).otherwise(0)})
    typeahead.apply(index, slice_, "p_partkey", "p_name", "p_size", F.col("out"))
    return typeahead.lists(spark, index)


@query(_CLOSURE + """, d AS (SELECT id, max(depth) AS depth FROM up GROUP BY id), n AS (SELECT ancestor_id AS id, count(*) AS size FROM up GROUP BY 1)
SELECT id, depth::INTEGER AS depth, size FROM d JOIN n USING (id)""")
def hie_07_interval_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIE-07: depth and subtree size of every node, from its preorder interval."""
    return intervals.labelled(_edges(spark, sf_dir)).select("id", "depth", "size")


@query(_CLOSURE + " SELECT id FROM up WHERE ancestor_id = 1002")
def hie_08_interval_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIE-01/08: everything below a node as one range of stored labels."""
    return intervals.subtree(stored(intervals.labelled(_edges(spark, sf_dir)), "tree-intervals"), 1002).select("id")


@query(f"""
WITH l AS (SELECT id, is_active, status || seniority AS f FROM {POSTINGS}),
r AS (SELECT CASE WHEN id % 97 = 0 THEN id + 100000000 ELSE id END AS id, CASE WHEN id % 13 = 0 THEN NOT is_active ELSE is_active END AS is_active, CASE WHEN id % 17 = 0 THEN 'x' ELSE status || seniority END AS f FROM {POSTINGS})
SELECT coalesce(l.id, r.id) AS key, left(sha256(coalesce(l.id, r.id)::VARCHAR), 4) AS leaf, CASE WHEN l.id IS NULL THEN 'delete' ELSE 'upsert' END AS action
FROM l FULL OUTER JOIN r ON l.id = r.id WHERE l.id IS NULL OR r.id IS NULL OR l.is_active <> r.is_active OR l.f <> r.f""")
def str_21_digest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-21: repairs of a stored mirror, found by digests of branches, then leaves, then rows."""
    local = postings(spark, sf_dir).select("id", "is_active", F.concat("status", "seniority").alias("fingerprint"))
    source = digesttree.build(local, "id", fresh_path(spark, "digests-source"))
    return digesttree.differences(spark, source, digesttree.build(_remote(spark, sf_dir), "id", fresh_path(spark, "digests-target")))


@query(f"SELECT id, status, seniority FROM {POSTINGS}")
def str_21_mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-21/22: a mirror that lost, gained and changed rows, after two runs of a cycle over all its branches."""
    local = postings(spark, sf_dir).select("id", "status", "seniority")
    i = F.col("id")
    old = local.select(F.when(i % 97 == 0, -i).otherwise(i).alias("id"), F.when(i % 17 == 0, "x").otherwise(F.col("status")).alias("status"), "seniority")
    source, target = digesttree.build(local, "id", fresh_path(spark, "digests-source")), digesttree.build(old, "id", fresh_path(spark, "digests-target"))
    book = fresh_path(spark, "digests-book")
    for _ in range(2):
        digesttree.run(spark, source, target, book, most=128)
    return digesttree.rows_of(spark, target)
