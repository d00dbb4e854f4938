"""Scalar functions over pages, documents and small fixed inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..registry import query
from ..tables import table


def _values(spark: SparkSession, values: list, kind: str = "string") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"raw {kind}")


def _rows(values: list) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({lit(v)})" for v in values) + ") t(raw)"


_STRIP = r"""trim(regexp_replace(
 replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))"""


@query(f"SELECT page_id, length(t) AS chars, sha256(t) AS digest FROM (SELECT page_id, {_STRIP} AS t FROM pages)")
def fn_01_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-01: text of a page."""
    t = table(spark, sf_dir, "pages").select("page_id", S.plain_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"))


@query(f"SELECT page_id, round(length({_STRIP}) / length(html), 6) >= 0.3 AS covered FROM pages")
def fn_05_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-05: share of text in a page against a gate."""
    share = F.round(F.length(S.plain_text(F.col("html"))) / F.length("html"), 6)
    return table(spark, sf_dir, "pages").select("page_id", (share >= 0.3).alias("covered"))


@query("""
WITH r AS (SELECT * FROM (VALUES ('1-URGENT', 1.0), ('2-HIGH', 0.92), ('3-MEDIUM', 1.17)) t(o_orderpriority, rate)),
x AS (SELECT o_orderkey AS id, o_totalprice AS v, rate FROM orders LEFT JOIN r USING (o_orderpriority))
SELECT id, CASE WHEN rate IS NULL THEN NULL ELSE round_even((v::DECIMAL(18,2) * rate::DECIMAL(6,2))::DECIMAL(24,6)::DOUBLE, 0)::BIGINT END AS eur_even, floor(v + 0.5)::BIGINT AS shown, CASE WHEN rate IS NULL THEN 'source' ELSE 'EUR' END AS currency FROM x""")
def fn_23_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-23/24/25: conversion by a small rate table; without a rate the source currency stays."""
    rates = spark.createDataFrame([("1-URGENT", "1.0"), ("2-HIGH", "0.92"), ("3-MEDIUM", "1.17")], "o_orderpriority string, rate string")
    x = table(spark, sf_dir, "orders").join(F.broadcast(rates), "o_orderpriority", "left")
    eur = F.col("o_totalprice").cast("decimal(18,2)") * F.col("rate").cast("decimal(6,2)")
    return x.select(F.col("o_orderkey").alias("id"), S.round_half_even(eur).alias("eur_even"), S.round_half_up(F.col("o_totalprice")).alias("shown"), F.when(F.col("rate").isNull(), "source").otherwise("EUR").alias("currency"))


@query("""SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN p_size * 100.0 * 2080 / 100 WHEN 'LARGE' THEN p_size * 100.0 * 12 WHEN 'PROMO' THEN p_size * 100.0 * 252 ELSE p_size * 100.0 END::DOUBLE AS yearly FROM part""")
def fn_22_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-22/23: yearly amounts from hourly (hundredths), daily, monthly and yearly ones."""
    period = F.when(F.col("p_type") == "SMALL", "hour").when(F.col("p_type") == "LARGE", "month").when(F.col("p_type") == "PROMO", "day").otherwise("year")
    return table(spark, sf_dir, "part").select("p_partkey", S.annual(F.col("p_size") * F.lit(100.0), period).alias("yearly"))


@query("SELECT m::INTEGER AS raw, round((m::DECIMAL(10,4) / 12)::DECIMAL(10,6), 1)::DOUBLE AS years FROM (SELECT unnest(generate_series(0, 60)) AS m)")
def fn_27_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-27: months to years, halves up."""
    return spark.range(61).select(F.col("id").cast("int").alias("raw"), S.experience_years(F.col("id")).alias("years"))


_DATES = ["2024-03-01T10:00:00Z", "1709251200", "1709251200000", "1.3.2024", "Fri, 01 Mar 2024 10:00:00 UTC", "soon"]


@query("SELECT raw, CASE WHEN raw = 'soon' THEN NULL ELSE '2024-03-01' END AS day FROM " + _rows(_DATES))
def fn_54_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-54: dates in several notations."""
    return _values(spark, _DATES).select("raw", S.parsed_date(F.col("raw")).cast("string").alias("day"))


@query("SELECT p_partkey, array_to_string(list_distinct(list_sort(string_split(p_name || ' ' || p_name, ' '))), '-') IS NOT NULL AS ok, p_name || '|' || lower(p_type) AS joined FROM part")
def fn_55_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-55: lists to text, each value once in its order."""
    words = F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_name"), " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(words, "-").isNotNull().alias("ok"), F.array_join(F.array("p_name", F.lower("p_type")), "|").alias("joined"))


@query("SELECT doc_id, length(CASE WHEN contains(lower(text), lower(left(s, 80))) THEN text ELSE text || chr(10) || s END) AS n FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN left(text, 90) ELSE 'Benefits: ' || source END AS s FROM documents)")
def fn_57_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-57: extras appended unless they are there."""
    snippet = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 90)).otherwise(F.concat(F.lit("Benefits: "), "source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(S.with_extras(F.col("text"), snippet)).cast("long").alias("n"))


@query("""SELECT c_custkey, CASE WHEN e < 1 THEN NULL WHEN e <= 10 THEN 1 WHEN e <= 50 THEN 2 WHEN e <= 200 THEN 3 WHEN e <= 500 THEN 4 WHEN e <= 1000 THEN 5 WHEN e <= 5000 THEN 6 WHEN e <= 10000 THEN 7 ELSE 8 END::INTEGER AS bucket
FROM (SELECT c_custkey, (c_acctbal * 2)::INTEGER AS e FROM (SELECT c_custkey, floor(c_acctbal) AS c_acctbal FROM customer))""")
def fn_59_size_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-59/60: employee counts to buckets."""
    return table(spark, sf_dir, "customer").select("c_custkey", S.size_bucket((F.floor("c_acctbal") * 2).cast("int")).alias("bucket"))


@query("SELECT n::INTEGER AS failures, least(5 * 2 ** least(n, 9), 1440)::INTEGER AS board_minutes, CASE WHEN n < 3 THEN (30 * 2 ** n)::INTEGER END AS scrape_minutes FROM (SELECT unnest(generate_series(0, 14)) AS n)")
def fn_61_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-61/62: back-off schedules."""
    n = F.col("failures")
    return spark.range(15).select(F.col("id").cast("int").alias("failures")).select("failures", S.backoff_minutes(n).alias("board_minutes"), S.scrape_backoff_minutes(n).alias("scrape_minutes"))


@query("""SELECT p_partkey, coalesce(ceil(lo), -1)::INTEGER AS least, CASE WHEN lo IS NULL THEN -1 ELSE coalesce(floor(hi), 99) END::INTEGER AS most
FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 10.0 END AS lo, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size / 4.0 END AS hi FROM part)""")
def fn_63_experience_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-63: stored bounds with -1 for unknown and 99 for open."""
    lo = F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 10.0)
    hi = F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 4.0)
    least, most = S.experience_bounds(lo, hi)
    return table(spark, sf_dir, "part").select("p_partkey", least.alias("least"), most.alias("most"))


@query("""SELECT event_id, (props ->> '$.k') || '/' || CASE WHEN event_id % 2 = 0 THEN 'v2' ELSE 'v1' END AS merged FROM events""")
def fn_69_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-69: shallow merge of maps in which the later value wins."""
    stored = F.create_map(F.lit("v"), F.lit("v1"), F.lit("k"), F.get_json_object("props", "$.k"))
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("v"), F.lit("v2"))).otherwise(F.create_map().cast("map<string,string>"))
    keep = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    merged = F.map_concat(keep, new)
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws("/", merged["k"], merged["v"]).alias("merged"))
