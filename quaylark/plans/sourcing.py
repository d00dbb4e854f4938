"""Sources over pages and small fixed inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import pagesource, readers
from ..tables import table


_LINKS = r"""SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=\s*["'']([^"''#][^"'']*)["'']', 1), lambda u: replace(u, '&amp;', '&')))) AS link FROM pages"""


@query(_LINKS)
def src_15_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15: links of pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(readers.links(F.col("html"))).alias("link"))


@query(_LINKS)
def src_21_registered_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-21: the registered source of stored pages, with the monitor that takes links."""
    pagesource.register(spark)
    return spark.read.format(pagesource.NAME).options(path=f"{sf_dir}/pages.parquet", monitor="links").load()


@query("SELECT event_id, TRY_CAST(value AS INTEGER) AS value, TRY_CAST(event_type AS BIGINT) AS event_type FROM (SELECT event_id, floor(value) AS value, event_type FROM events)")
def src_04_lenient_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04: projection with casts that give null instead of failing."""
    return readers.lenient(table(spark, sf_dir, "events").withColumn("value", F.floor("value")), {"event_id": "bigint", "value": "int", "event_type": "bigint"})


@query("""
WITH p AS (SELECT event_id, event_id // 100 AS page, ts FROM events), o AS (SELECT page, min(ts) AS m FROM p GROUP BY 1), s AS (SELECT min(page) AS stop FROM (SELECT 99 - page AS page FROM p GROUP BY 1 HAVING max(ts) <= TIMESTAMP '2024-01-10'))
SELECT count(*) AS n FROM (SELECT 99 - event_id // 100 AS page FROM events), s WHERE stop IS NULL OR page < stop + 2""")
def src_18_incremental_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18/19: pages newest first until one is wholly old, and two safety pages."""
    items = table(spark, sf_dir, "events").select((F.lit(99) - F.floor(F.col("event_id") / 100)).alias("page"), "ts")
    return readers.new_pages(items, "page", "ts", F.lit("2024-01-10").cast("timestamp_ntz"), 2).agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'sitemap' WHEN contains(html, 'href') THEN 'dom' WHEN contains(url, 'page=') THEN 'api' END AS monitor FROM pages)
SELECT monitor, count(*) AS n FROM m GROUP BY 1""")
def src_23_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-21/22/23: the cheapest monitor that can handle a page."""
    rules = [("api", 3, F.col("url").contains("page=")), ("sitemap", 1, F.col("url").contains("/en/")), ("dom", 2, F.col("html").contains("href"))]
    return readers.best_detector(table(spark, sf_dir, "pages"), rules).groupBy("monitor").agg(F.count("*").alias("n"))


@query("""
WITH f AS (SELECT doc_id % 50 AS id, lang, min(source) AS title FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2)
SELECT id, coalesce(max(title) FILTER (lang = 'de'), arg_min(title, lang)) AS title, string_agg(lang, ',' ORDER BY lang) AS locales FROM f GROUP BY 1""")
def src_29_merge_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-29: feeds of several languages merged by id."""
    f = table(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy((F.col("doc_id") % 50).alias("id"), "lang").agg(F.min("source").alias("title"))
    m = readers.merge_locales(f, "id", "lang", ["title"], "de")
    return m.select("id", "title", F.array_join(F.array_sort(F.map_keys("localizations")), ",").alias("locales"))


@query("SELECT (SELECT count(*) FROM orders) AS advertised, (SELECT count(*) FROM orders WHERE o_orderkey % 200 <> 0) AS found")
def src_28_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-28: a cycle that found too few fails; here it found all but half a percent."""
    n = table(spark, sf_dir, "orders").agg(F.count("*").alias("advertised"), F.count_if(F.col("o_orderkey") % 200 != 0).alias("found"))
    short = F.col("found") < F.col("advertised") - F.greatest(F.lit(1), F.ceil(F.col("advertised") / 100))
    return n.select("advertised", F.when(short, F.raise_error(F.lit("incomplete cycle")).cast("bigint")).otherwise(F.col("found")).alias("found"))
