"""Search, typeahead, parsing and extraction over names, pages and documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract, htmltree, languages
from ..operators import textsearch
from ..registry import query
from ..tables import companies, postings, table

_INDEX = "(SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS token FROM part)"


def _match_sql(words: tuple[str, ...]) -> str:
    near = lambda w: f"OR levenshtein(token, '{w}') = 1" if len(w) >= 4 else ""
    each = " UNION ALL ".join(
        f"SELECT p_partkey, {i} AS word, CASE WHEN starts_with(token, '{w}') THEN 0 ELSE 1 END AS edits, (token = '{w}')::INTEGER AS exact FROM i WHERE starts_with(token, '{w}') {near(w)}" for i, w in enumerate(words)
    )
    return f"""
WITH i AS (SELECT * FROM {_INDEX}), h AS ({each}), b AS (SELECT p_partkey, word, min(edits) AS edits, max(exact) AS exact FROM h GROUP BY 1, 2)
SELECT p_partkey, count(*) AS matched, sum(edits)::BIGINT AS edits, sum(exact)::BIGINT AS exact FROM b GROUP BY 1"""


@query(_match_sql(("stel", "widg")))
def txt_01_keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-01/02/03/16/18: exact, prefix and one-edit matches with their score."""
    index = textsearch.inverted_index(table(spark, sf_dir, "part"), "p_partkey", "p_name")
    return textsearch.matched(index, "p_partkey", ["stel", "widg"])


@query(f"""
WITH s AS ({_match_sql(("red",))}), r AS (SELECT p_brand, p_partkey, matched, row_number() OVER (PARTITION BY p_brand ORDER BY matched DESC, edits, exact DESC, p_partkey) AS rank FROM s JOIN part USING (p_partkey))
SELECT p_brand, p_partkey, rank::INTEGER AS rank, (SELECT count(DISTINCT p_brand) FROM r) AS total_groups FROM r WHERE rank <= 3""")
def txt_01_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-01/13: hits grouped, three a group, with the number of groups."""
    part = table(spark, sf_dir, "part")
    hits = textsearch.matched(textsearch.inverted_index(part, "p_partkey", "p_name"), "p_partkey", ["red"]).join(part.select("p_partkey", "p_brand"), "p_partkey")
    w = Window.partitionBy("p_brand").orderBy(F.desc("matched"), "edits", F.desc("exact"), "p_partkey")
    total = hits.agg(F.countDistinct("p_brand").alias("total_groups"))
    return hits.withColumn("rank", F.row_number().over(w)).where("rank <= 3").crossJoin(F.broadcast(total)).select("p_brand", "p_partkey", "rank", "total_groups")


@query(f"""
WITH s AS ({_match_sql(("plate", "zzzz", "red"))}), r AS (SELECT * FROM s JOIN part USING (p_partkey) WHERE matched = (SELECT max(matched) FROM s))
SELECT p_partkey, row_number() OVER (ORDER BY edits, exact DESC, p_retailprice DESC, p_partkey)::INTEGER AS place FROM r ORDER BY place LIMIT 20""")
def txt_01_dropped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-01: a word that matches nothing beside the others is dropped; fewer edits, exact words, then the newest first (top-k)."""
    part = table(spark, sf_dir, "part")
    hits = textsearch.most_words(textsearch.matched(textsearch.inverted_index(part, "p_partkey", "p_name"), "p_partkey", ["plate", "zzzz", "red"]))
    rows = hits.join(part.select("p_partkey", "p_retailprice"), "p_partkey")
    order = [F.asc("edits"), F.desc("exact"), F.desc("p_retailprice"), F.asc("p_partkey")]
    return textsearch.numbered_top(rows, order, 20).select("p_partkey", "place")


@query(f"""
WITH s AS ({_match_sql(("plata",))}), r AS (SELECT part.* FROM s JOIN part USING (p_partkey))
SELECT 'brand' AS facet, p_brand AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'type', p_type, count(*) FROM r GROUP BY 2""")
def txt_01_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-01: facet counts of all hits of a keyword search, both facets from one pass."""
    part = table(spark, sf_dir, "part")
    hits = textsearch.matched(textsearch.inverted_index(part, "p_partkey", "p_name"), "p_partkey", ["plata"])
    values = F.array(F.struct(F.lit("brand").alias("facet"), F.col("p_brand").alias("value")), F.struct(F.lit("type").alias("facet"), F.col("p_type").alias("value")))
    return part.join(hits, "p_partkey", "left_semi").select(F.inline(values)).groupBy("facet", "value").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey FROM customer WHERE starts_with(lower(c_name), 'customer#00000001') ORDER BY c_acctbal DESC, c_custkey LIMIT 10""")
def txt_07_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-05/06/07/08/09: typeahead by prefix, heavier names first; symbols belong to tokens."""
    return textsearch.suggest(table(spark, sf_dir, "customer"), "c_custkey", "c_name", "Customer#00000001", "c_acctbal", 10).select("c_custkey")


@query("""
WITH p AS (SELECT s_suppkey AS id, (s_suppkey % 90)::DOUBLE AS lat, (s_suppkey % 180)::DOUBLE AS lng FROM supplier),
d AS (SELECT id, floor(12742.0 * asin(sqrt(pow(sin(radians(lat - 45.0) / 2), 2) + cos(radians(45.0)) * cos(radians(lat)) * pow(sin(radians(lng - 90.0) / 2), 2))) / 5)::BIGINT AS ring FROM p)
SELECT id, ring FROM d ORDER BY ring, id LIMIT 20""")
def txt_04_geo_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-04: places by rings of 5 km around a point."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 90).cast("double").alias("lat"), (F.col("s_suppkey") % 180).cast("double").alias("lng"))
    km = textsearch.haversine_km(F.lit(45.0), F.lit(90.0), F.col("lat"), F.col("lng"))
    return s.select("id", F.floor(km / 5).alias("ring")).orderBy("ring", "id").limit(20)


@query("""
WITH r AS (SELECT c_custkey AS company_id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer WHERE c_mktsegment = 'BUILDING'),
f AS (SELECT DISTINCT o_custkey AS company_id FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 300000)
SELECT company_id, rank::INTEGER AS rank FROM r LEFT JOIN f USING (company_id) WHERE rank <= 40""")
def txt_10_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-10/13/15, JOI-23: candidates with a filtered posting first, stable."""
    c = companies(spark, sf_dir).where("industry = 'BUILDING'").orderBy(F.desc("balance"), "company_id").limit(40)
    ranked = c.select("company_id", F.row_number().over(Window.orderBy(F.desc("balance"), "company_id")).alias("rank"))
    favoured = postings(spark, sf_dir).where("is_active AND seniority = '1-URGENT' AND salary > 300000")
    return textsearch.boosted(ranked, favoured, "company_id", "rank")


@query("""
SELECT 'company' AS kind, c_custkey AS id FROM (SELECT * FROM customer WHERE c_name LIKE '%#000000012%' ORDER BY c_custkey LIMIT 5)
UNION ALL SELECT 'place', n_nationkey FROM (SELECT * FROM nation WHERE n_name LIKE 'NATION_1%' ORDER BY n_nationkey LIMIT 5)
UNION ALL SELECT 'part', p_partkey FROM (SELECT * FROM part WHERE p_name LIKE 'red%' ORDER BY p_partkey LIMIT 5)""")
def txt_11_many_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-11: one typeahead over several collections, five of each (top-k)."""
    first = lambda df, key, name, typed, kind: df.where(F.contains(F.lower(name), F.lit(typed))).orderBy(key).limit(5).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"))
    a = first(table(spark, sf_dir, "customer"), "c_custkey", "c_name", "#000000012", "company")
    b = first(table(spark, sf_dir, "nation"), "n_nationkey", "n_name", "nation_1", "place")
    p = table(spark, sf_dir, "part").where(F.startswith(F.lower("p_name"), F.lit("red"))).orderBy("p_partkey").limit(5).select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"))
    return a.unionByName(b).unionByName(p)


DICTIONARIES = {
    "mode": {"remote": "remote", "work from home": "remote", "hybrid": "hybrid"},
    "seniority": {"senior": "senior", "junior": "junior", "entry level": "junior"},
    "technology": {"python": "python", "c++": "c++", "apache spark": "spark"},
    "place": {"berlin": "berlin", "new york": "new-york", "zurich": "zurich"},
    "occupation": {"engineer": "engineer", "data scientist": "data-scientist", "nurse": "nurse"},
}


@query("""
WITH me AS (SELECT s_nationkey, s_suppkey FROM supplier WHERE s_suppkey = 3), pool AS (SELECT s.s_suppkey, s.s_acctbal FROM supplier s JOIN me ON s.s_nationkey = me.s_nationkey WHERE s.s_suppkey <> me.s_suppkey ORDER BY s.s_acctbal DESC, s.s_suppkey LIMIT 100),
n AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s_suppkey, coalesce(n, 0) AS n FROM pool LEFT JOIN n ON l_suppkey = s_suppkey ORDER BY n DESC, s_suppkey LIMIT 10""")
def txt_15_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-14/15: the same group without oneself, a pool of 100 re-ranked by filtered counts (top-k)."""
    s = table(spark, sf_dir, "supplier")
    me = s.where("s_suppkey = 3").select(F.col("s_nationkey").alias("nk"), F.col("s_suppkey").alias("me"))
    pool = s.join(F.broadcast(me), (F.col("s_nationkey") == F.col("nk")) & (F.col("s_suppkey") != F.col("me"))).orderBy(F.desc("s_acctbal"), "s_suppkey").limit(100)
    n = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return pool.join(n, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "s_suppkey").limit(10)


@query("""SELECT a.n_nationkey AS id, p.r_name || '/' || a.n_name AS full_name FROM nation a JOIN region p ON a.n_regionkey = p.r_regionkey WHERE lower(a.n_name) IN ('nation_3', 'nation_14')""")
def txt_17_slug_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-17: slugs to places with their parent's name."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.where(F.lower("n_name").isin("nation_3", "nation_14")).join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("id"), F.concat_ws("/", "r_name", "n_name").alias("full_name"))


@query(r"""
WITH t AS (SELECT r_name, list_distinct(list_transform(generate_series(1, length(r_name) + 1), lambda i: substr('  ' || lower(r_name) || ' ', i, 3))) AS g FROM region),
q AS (SELECT list_distinct(list_transform(generate_series(1, length('amerika') + 1), lambda i: substr('  amerika ', i, 3))) AS g)
SELECT r_name, round(len(list_intersect(t.g, q.g)) / len(list_distinct(list_concat(t.g, q.g))), 6) AS similarity FROM t, q""")
def txt_19_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-19: trigram similarity of names."""
    r = table(spark, sf_dir, "region")
    return r.select("r_name", F.round(textsearch.similarity(textsearch.trigrams(F.col("r_name")), textsearch.trigrams(F.lit("amerika"))), 6).alias("similarity"))


# --- extraction -----------------------------------------------------------------------


def _language_model(spark: SparkSession, sf_dir: str) -> tuple[list[str], np.ndarray]:
    """Learnt from three quarters of the labelled documents; the rest is held out (tests state the accuracy on it)."""
    docs = table(spark, sf_dir, "documents")
    return languages.learn(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2), "text", "lang")


@query()
def fn_07_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-07: language of the first 500 characters by learnt trigram probabilities; null without a clear lead."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return languages.with_languages(docs, "text", _language_model(spark, sf_dir)).select("doc_id", "lang", F.col("language").alias("found"))


@query()
def fn_08_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-08/09: languages of 15 % or more of a text's chunks of 500 characters (80 at least), largest first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = languages.with_languages(docs, "text", _language_model(spark, sf_dir))
    return found.select("doc_id", F.posexplode("languages").alias("place", "lang"))


@query()
def fn_06_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-04/06, SRC-14: blocks of pages (tests compare with fixed pages)."""
    return extract.blocks(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def fn_03_clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-03: pages with their structure, allowed tags without attributes only (tests: exact trees, and no visible text lost)."""
    return htmltree.cleaned(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def fn_04_labelled_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-04/05: pages as blocks for labelling, their plain text, its share of the visible text, and what the parser met."""
    return htmltree.normalised(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "labelled", "text", "coverage", "strays", "broken")
