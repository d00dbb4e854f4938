"""Read side: filters, facets, histograms, pages and grouped hits over postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import facets, filters
from ..registry import query
from ..tables import COMPANIES, POSTINGS, companies, postings, table, total


def _per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with an interval [least, most] of quantities; -1 where there is no line."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return postings(spark, sf_dir).join(lines, "id", "left").select("id", F.coalesce("lo", F.lit(-1.0)).alias("lo"), F.coalesce("hi", F.lit(-1.0)).alias("hi"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their name as an array; ``_none`` where the type is SMALL (unknown)."""
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_type") == "SMALL", F.array(F.lit("_none"))).otherwise(words).alias("words"), "p_type", "p_brand")


_TOKENS = "(SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN ['_none'] ELSE string_split(p_name, ' ') END AS words, p_type, p_brand FROM part)"


@query(f"""
WITH p AS (SELECT * FROM {POSTINGS} WHERE is_active AND salary BETWEEN 50000 AND 400000),
g AS (SELECT company_id, count(*) AS hits, max(first_seen) AS newest FROM p GROUP BY company_id)
SELECT g.company_id, c.name, hits, strftime(newest, '%Y-%m-%d') AS newest, (SELECT count(*) FROM g) AS total_companies
FROM g JOIN {COMPANIES} c USING (company_id) ORDER BY hits DESC, newest DESC, company_id LIMIT 10""")
def search_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top companies by matching postings with the number of matching companies (flagship)."""
    hits = postings(spark, sf_dir).where(F.col("is_active") & filters.salary_between("salary", 50_000, 400_000))
    groups = hits.groupBy("company_id").agg(F.count("*").alias("hits"), F.max("first_seen").alias("newest"))
    ranked = groups.orderBy(F.desc("hits"), F.desc("newest"), "company_id").limit(10)
    found = groups.agg(F.count("*").alias("total_companies"))
    return ranked.join(companies(spark, sf_dir), "company_id").crossJoin(F.broadcast(found)).select("company_id", "name", "hits", F.date_format("newest", "yyyy-MM-dd").alias("newest"), "total_companies")


@query(f"""
SELECT id, company_id, salary FROM {POSTINGS}
WHERE status IN ('O', 'P') AND salary BETWEEN 100000 AND 300000 AND seniority IN ('1-URGENT', '2-HIGH')""")
def flt_01_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01/05/07: a conjunction of optional clauses."""
    clause = filters.one_of("status", ["O", "P"]) & filters.salary_between("salary", 100_000, 300_000) & filters.one_of("seniority", ["1-URGENT", "2-HIGH"])
    return postings(spark, sf_dir).where(clause).select("id", "company_id", "salary")


_CONTENT = "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN FALSE ELSE TRUE END"


def _with_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("id") % 7
    return postings(spark, sf_dir).withColumn("has_content", F.when(r == 0, F.lit(None)).when(r == 1, F.lit(False)).otherwise(F.lit(True)))


@query(f"""
SELECT count(*) FILTER (is_active AND h IS DISTINCT FROM FALSE) AS live, count(*) FILTER (h IS DISTINCT FROM FALSE) AS flow, count(*) AS n
FROM (SELECT *, {_CONTENT} AS h FROM {POSTINGS})""")
def flt_02_live_and_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-02/03: absent content is visible; delisted rows stay in the flow."""
    return _with_content(spark, sf_dir).agg(F.count_if(filters.live()).alias("live"), F.count_if(filters.visible()).alias("flow"), F.count("*").alias("n"))


@query(f"SELECT p_partkey FROM {_TOKENS} WHERE list_has_any(words, ['red', 'steel', '_none'])")
def flt_09_language_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04/09: array overlap; unknown matches every language."""
    return _tokens(spark, sf_dir).where(filters.spoken("words", ["red", "steel"])).select("p_partkey")


@query("SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN [] ELSE string_split(p_name, ' ') END AS w FROM part) WHERE list_has_any(w, ['blue']) OR len(w) = 0")
def flt_10_overlap_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06/10: overlap, or an empty array."""
    words = F.when(F.col("p_type") == "SMALL", F.array().cast("array<string>")).otherwise(F.split("p_name", " "))
    return table(spark, sf_dir, "part").select("p_partkey", words.alias("w")).where(filters.spoken_or_empty("w", ["blue"])).select("p_partkey")


@query(f"""
WITH l AS (SELECT l_orderkey AS id, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1),
p AS (SELECT o.id, coalesce(lo, -1.0) AS lo, coalesce(hi, -1.0) AS hi FROM {POSTINGS} o LEFT JOIN l USING (id))
SELECT id, lo, hi FROM p WHERE (lo <= 8 AND hi >= 3) OR lo = -1""")
def flt_08_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08: intervals that meet [3, 8], or no information."""
    return _per_order(spark, sf_dir).where(filters.intervals_overlap("lo", "hi", 3, 8))


@query(r"SELECT page_id FROM pages WHERE regexp_matches(url, '/(en|de)/') AND NOT regexp_matches(url, 'page=|#top')")
def flt_12_url_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12: include and exclude patterns on the URL."""
    return table(spark, sf_dir, "pages").where(filters.matches(F.col("url"), "/(en|de)/", "page=|#top")).select("page_id")


@query(r"""
SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE concat_ws(chr(10), text, source) END AS c FROM documents)
WHERE c IS NULL OR (regexp_matches(c, 'License|src1') AND NOT regexp_matches(c, '[0-9]{8}'))""")
def flt_13_content_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13: the same over content; rows without content are kept."""
    content = F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.concat_ws("\n", "text", "source"))
    return table(spark, sf_dir, "documents").where(filters.matches(content, "License|src1", "[0-9]{8}", keep_null=True)).select("doc_id")


@query(r"SELECT DISTINCT regexp_replace(regexp_replace(url, '^http:', 'https:'), '[?#].*$', '') AS url FROM pages")
def flt_14_url_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14: rewrite, then one row a URL."""
    new = F.regexp_replace(F.regexp_replace("url", "^http:", "https:"), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(new.alias("url")).distinct()


_URLS = "(SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^(https?://[^/]+).*$', '\\1') WHEN 2 THEN regexp_replace(url, '^https?://', '') WHEN 3 THEN regexp_replace(url, '^(https?://[^/]+/[^/]+).*$', '\\1') ELSE url END AS u FROM pages)"


@query(rf"""
WITH p AS (SELECT page_id, u, regexp_extract(u, '^https?://([^/?#\s]+)', 1) AS host, regexp_extract(u, '^https?://[^/?#\s]+(/[^?#]*)', 1) AS path, regexp_extract(u, '^https?://[^/?#\s]+(?:/[^?#]*)?(\?[^#]*)', 1) AS q FROM {_URLS}),
k AS (SELECT CASE WHEN host = '' OR NOT contains(host, '.') THEN 'invalid' WHEN len(list_filter(string_split(path, '/'), lambda x: x <> '')) = 0 AND q = '' THEN 'bare_host'
 WHEN len(list_filter(string_split(path, '/'), lambda x: x <> '')) <= 1 THEN 'board_homepage' ELSE 'ok' END AS kind FROM p)
SELECT kind, count(*) AS n FROM k GROUP BY kind""")
def flt_15_url_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15: plausible URL classes."""
    r = F.col("page_id") % 5
    u = (
        F.when(r == 1, F.regexp_replace("url", "^(https?://[^/]+).*$", "$1"))
        .when(r == 2, F.regexp_replace("url", "^https?://", ""))
        .when(r == 3, F.regexp_replace("url", "^(https?://[^/]+/[^/]+).*$", "$1"))
        .otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select(filters.url_kind(u).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, (props ->> '$.k')::BIGINT AS k FROM events)
SELECT user_id, k, min(event_id) AS event_id FROM e WHERE event_type NOT IN ('error', 'view') AND NOT regexp_matches(k::VARCHAR, '^1') GROUP BY user_id, k""")
def flt_16_item_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16: exclude values and patterns, then one item for each path."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    kept = e.where(~F.col("event_type").isin("error", "view") & ~F.col("k").cast("string").rlike("^1"))
    return kept.groupBy("user_id", "k").agg(F.min("event_id").alias("event_id"))


@query("""SELECT count(*) FILTER (coalesce(k > 50, FALSE)) AS skipped, count(*) FILTER (NOT coalesce(k > 50, FALSE)) AS kept
FROM (SELECT CASE WHEN event_id % 9 = 0 THEN NULL ELSE (props ->> '$.k')::BIGINT END AS k FROM events)""")
def flt_17_json_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17: a flag inside JSON; a missing key does not skip."""
    k = F.when(F.col("event_id") % 9 == 0, F.lit(None)).otherwise(F.get_json_object("props", "$.k").cast("long"))
    skip = F.coalesce(k > 50, F.lit(False))
    return table(spark, sf_dir, "events").agg(F.count_if(skip).alias("skipped"), F.count_if(~skip).alias("kept"))


@query(f"""SELECT p.company_id, count(*) AS n FROM {POSTINGS} p JOIN {COMPANIES} c USING (company_id)
WHERE p.is_active AND c.balance < 0 AND c.industry IN ('BUILDING', 'MACHINERY') GROUP BY 1""")
def flt_18_phantom_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-18: live postings of sources that have ended."""
    ended = companies(spark, sf_dir).where((F.col("balance") < 0) & F.col("industry").isin("BUILDING", "MACHINERY"))
    return postings(spark, sf_dir).where("is_active").join(ended, "company_id", "left_semi").groupBy("company_id").agg(F.count("*").alias("n"))


@query("""
WITH w AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS companies, count(*) FILTER (event_type = 'click') AS keywords, count(*) FILTER (event_type = 'purchase') AS taxonomy, min(ts) AS created,
 (SELECT max(ts) FROM events) AS as_of FROM events GROUP BY user_id)
SELECT user_id, companies + keywords + taxonomy = 0 AS is_trivial,
 len('list ' || user_id) >= 4 AND created <= as_of - INTERVAL 7 DAY AND (companies >= 14 OR keywords >= 16 OR taxonomy >= 15) AS qualifies FROM w""")
def flt_20_qualifying_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-19/20/21: trivial and qualifying saved lists, as a grouped HAVING."""
    e = table(spark, sf_dir, "events")
    of = lambda t: F.count_if(F.col("event_type") == t)
    lists = e.groupBy("user_id").agg(of("view").alias("companies"), of("click").alias("keywords"), of("purchase").alias("taxonomy"), F.min("ts").alias("created"))
    asof = e.agg(F.max("ts").alias("asof"))
    old = F.col("created") <= F.col("asof") - F.expr("INTERVAL 7 DAYS")
    rich = (F.col("companies") >= 14) | (F.col("keywords") >= 16) | (F.col("taxonomy") >= 15)
    empty = F.col("companies") + F.col("keywords") + F.col("taxonomy") == 0
    named = F.length(F.concat(F.lit("list "), F.col("user_id").cast("string"))) >= 4
    return lists.crossJoin(F.broadcast(asof)).select("user_id", empty.alias("is_trivial"), (named & old & rich).alias("qualifies"))


@query("SELECT doc_id FROM documents WHERE source = 'src1' AND lang = 'en' AND n_chars >= 1000")
def flt_23_scrub_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-23: a conjunction of the fields that are set; an empty one is refused."""
    return table(spark, sf_dir, "documents").where(scrub_predicate(source="src1", lang="en", least_chars=1000)).select("doc_id")


def scrub_predicate(source: str | None = None, lang: str | None = None, least_chars: int | None = None) -> Column:
    clauses = [F.col(c) == v for c, v in (("source", source), ("lang", lang)) if v is not None]
    if least_chars is not None:
        clauses.append(F.col("n_chars") >= least_chars)
    if not clauses:
        raise ValueError("a scrub without any condition would match every row")
    return reduce(lambda a, b: a & b, clauses)


@query(f"""
WITH a AS (SELECT id, status, salary, seniority FROM {POSTINGS}),
b AS (SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE status END AS status2, CASE WHEN id % 15 = 0 THEN salary + 1 ELSE salary END AS salary2, seniority AS seniority2 FROM a)
SELECT a.id FROM a JOIN b USING (id) WHERE status IS DISTINCT FROM status2 OR salary IS DISTINCT FROM salary2 OR seniority IS DISTINCT FROM seniority2""")
def flt_24_null_safe_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-24: any of several columns changed, null counting as a value."""
    a = postings(spark, sf_dir).select("id", "status", "salary", "seniority")
    b = a.select("id", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("status")).alias("status2"), F.when(F.col("id") % 15 == 0, F.col("salary") + 1).otherwise(F.col("salary")).alias("salary2"), F.col("seniority").alias("seniority2"))
    return a.join(b, "id").where(filters.changed([("status", "status2"), ("salary", "salary2"), ("seniority", "seniority2")])).select("id")


# --- facets and histograms -----------------------------------------------------


@query(f"SELECT company_id, count(*) AS n FROM {POSTINGS} WHERE is_active GROUP BY company_id")
def agg_01_facet_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01: exhaustive facet."""
    return facets.facet(postings(spark, sf_dir).where("is_active"), "company_id")


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(words)) AS word FROM {_TOKENS}) GROUP BY word")
def agg_02_facet_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02/41: facet over an array column, each value once a row."""
    return facets.facet_array(_tokens(spark, sf_dir), "words", "word")


@query(f"SELECT count(DISTINCT company_id) AS total_values, count(*) AS found FROM {POSTINGS} WHERE is_active AND salary >= 200000")
def agg_03_distinct_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03/04/39: facet cardinality and total hits, exact."""
    return postings(spark, sf_dir).where("is_active AND salary >= 200000").agg(F.countDistinct("company_id").alias("total_values"), F.count("*").alias("found"))


@query(f"""SELECT count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS missing, count(*) FILTER (salary > 250000) AS paid, count(*) FILTER (seniority = '1-URGENT') AS urgent,
 count(*) FILTER (is_active AND salary > 250000) AS active_paid, count(*) AS n FROM {POSTINGS}""")
def agg_05_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05/06: several conditional counts in one pass."""
    a, paid = F.col("is_active"), F.col("salary") > 250_000
    return postings(spark, sf_dir).agg(
        F.count_if(a).alias("active"), F.count_if(~a).alias("missing"), F.count_if(paid).alias("paid"),
        F.count_if(F.col("seniority") == "1-URGENT").alias("urgent"), F.count_if(a & paid).alias("active_paid"), F.count("*").alias("n"),
    )


@query(f"SELECT least(floor(salary / 10000), 30)::BIGINT AS bin, count(*) AS n FROM {POSTINGS} WHERE is_active GROUP BY 1")
def agg_11_salary_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: 30 bins of 10,000 and an open last one."""
    return facets.histogram(postings(spark, sf_dir).where("is_active"), F.col("salary"), 10_000, 30)


@query("SELECT p_size, n FROM (SELECT p_size, count(*) AS n FROM part WHERE p_size >= 0 GROUP BY 1 ORDER BY n DESC, p_size LIMIT 30)")
def agg_12_experience_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12: the 30 most frequent integers, in their own order."""
    return facets.integer_facet(table(spark, sf_dir, "part"), "p_size", 30)


_ASOF = "(SELECT max(o_orderdate) FROM orders)"


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return F.broadcast(table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("asof")))


@query(f"""SELECT company_id, count(*) FILTER (first_seen >= {_ASOF} - INTERVAL 12 MONTH) AS calendar_year, count(*) FILTER (first_seen >= {_ASOF} - INTERVAL 365 DAY) AS fixed_year
FROM {POSTINGS} GROUP BY company_id""")
def agg_13_year_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13/14: postings of the last year, by calendar and by 365 days."""
    df = postings(spark, sf_dir).crossJoin(_asof(spark, sf_dir))
    return df.groupBy("company_id").agg(
        F.count_if(F.col("first_seen") >= F.expr("asof - INTERVAL 12 MONTHS")).alias("calendar_year"),
        F.count_if(F.col("first_seen") >= F.expr("asof - INTERVAL 365 DAYS")).alias("fixed_year"),
    )


@query(f"""
WITH n AS (SELECT company_id, count(*) FILTER (is_active) AS active, count(*) AS year FROM {POSTINGS} WHERE seniority = '1-URGENT' GROUP BY 1)
SELECT c.company_id, coalesce(active, 0) AS active, coalesce(year, 0) AS year, coalesce(active, 0) > 0 AS has_postings FROM {COMPANIES} c LEFT JOIN n USING (company_id)""")
def agg_15_counts_with_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15/SET-02: counts over the authority list, zeros kept."""
    n = postings(spark, sf_dir).where("seniority = '1-URGENT'").groupBy("company_id").agg(F.count_if("is_active").alias("active"), F.count("*").alias("year"))
    out = facets.with_zeros(companies(spark, sf_dir).select("company_id"), n, "company_id", ["active", "year"])
    return out.withColumn("has_postings", F.col("active") > 0)


@query(f"SELECT string_agg(seniority || '=' || n, ';' ORDER BY seniority) AS counts FROM (SELECT seniority, count(*) AS n FROM {POSTINGS} WHERE is_active GROUP BY 1)")
def agg_16_facet_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16/17: a whole facet as one map value."""
    f = facets.facet(postings(spark, sf_dir).where("is_active"), "seniority")
    entries = F.array_sort(F.collect_list(F.struct("seniority", "n")))
    as_map = f.agg(F.map_from_entries(entries).alias("m"))
    return as_map.select(F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("counts"))


@query("""
WITH f AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_type, sum(n)::BIGINT AS total, string_agg(p_brand || ':' || n, ',' ORDER BY n DESC, p_brand) AS brands FROM f GROUP BY 1""")
def agg_18_grouped_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18/20: a facet nested under its category, with totals."""
    f = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "p_brand", "n")))
    return f.groupBy("p_type").agg(F.sum("n").alias("total"), F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["p_brand"], r["n"].cast("string"))), ",").alias("brands"))


@query(f"SELECT seniority, count(*) AS n, row_number() OVER (ORDER BY seniority)::INTEGER AS position FROM {POSTINGS} WHERE is_active GROUP BY 1")
def agg_19_ordered_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19/42: options in their logical order, not by count."""
    f = facets.facet(postings(spark, sf_dir).where("is_active"), "seniority")
    ids = {s: i for i, s in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), 1)}
    position = F.element_at(F.create_map(*[F.lit(x) for kv in ids.items() for x in kv]), F.col("seniority"))
    return f.withColumn("position", position)


@query(f"SELECT (SELECT count(*) FROM {POSTINGS} WHERE is_active) AS active_postings, (SELECT count(*) FROM {COMPANIES}) AS companies")
def agg_24_site_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-24: two counts."""
    a = postings(spark, sf_dir).where("is_active").agg(F.count("*").alias("active_postings"))
    return a.crossJoin(companies(spark, sf_dir).agg(F.count("*").alias("companies")))


@query(f"""
WITH lists AS (SELECT * FROM (VALUES (1, 'urgent', '1-URGENT', 0.0), (2, 'rich', NULL, 400000.0), (3, 'any', NULL, 0.0)) t(list_id, title, seniority, least))
SELECT l.list_id, count(p.id) AS hits, count(DISTINCT p.company_id) AS companies FROM lists l LEFT JOIN (SELECT * FROM {POSTINGS} WHERE is_active) p ON (l.seniority IS NULL OR p.seniority = l.seniority) AND p.salary >= l.least GROUP BY 1""")
def agg_38_saved_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-38/39: counts of a few saved filters in one pass over the postings."""
    lists = ((1, filters.one_of("seniority", ["1-URGENT"])), (2, F.col("salary") >= 400_000), (3, filters.true()))
    aggs = [c for i, f in lists for c in (F.count_if(f).alias(f"hits_{i}"), F.countDistinct(F.when(f, F.col("company_id"))).alias(f"companies_{i}"))]
    one = postings(spark, sf_dir).where("is_active").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("list_id"), F.col(f"hits_{i}").alias("hits"), F.col(f"companies_{i}").alias("companies")) for i, _ in lists])
    return one.select(F.inline(rows))


# --- sorting, pages, groups ----------------------------------------------------


@query(f"SELECT id, first_seen::DATE::VARCHAR AS day FROM (SELECT * FROM {POSTINGS} WHERE is_active ORDER BY salary DESC, first_seen DESC, id LIMIT 20 OFFSET 40)")
def srt_02_page_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-01/02: the page that holds offset 47 of pages of 20."""
    order = [F.desc("salary"), F.desc("first_seen"), F.asc("id")]
    return facets.page(postings(spark, sf_dir).where("is_active"), order, 47, 20).select("id", F.col("first_seen").cast("date").cast("string").alias("day"))


@query(f"SELECT company_id, n FROM (SELECT company_id, count(*) AS n FROM {POSTINGS} WHERE is_active GROUP BY 1 ORDER BY n DESC, company_id LIMIT 15 OFFSET 5)")
def srt_03_facet_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-03/04: facet values by count, a slice of them."""
    return facets.top(facets.facet(postings(spark, sf_dir).where("is_active"), "company_id"), [F.desc("n"), F.asc("company_id")], 15, 5)


@query(f"""
WITH g AS (SELECT company_id, count(*) AS n, count(*) FILTER (is_active) AS a, max(salary) AS best FROM {POSTINGS} GROUP BY 1)
SELECT company_id, rank FROM (SELECT company_id, row_number() OVER (ORDER BY a > 0 DESC, a DESC, n DESC, best DESC, company_id) AS rank FROM g) WHERE rank <= 25""")
def srt_05_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-05/06/07: groups with matches first, then several keys."""
    g = postings(spark, sf_dir).groupBy("company_id").agg(F.count("*").alias("n"), F.count_if("is_active").alias("a"), F.max("salary").alias("best"))
    first = facets.top(g, [F.desc(F.col("a") > 0), F.desc("a"), F.desc("n"), F.desc("best"), F.asc("company_id")], 25)
    w = Window.orderBy(F.desc(F.col("a") > 0), F.desc("a"), F.desc("n"), F.desc("best"), "company_id")
    return first.select("company_id", F.row_number().over(w).cast("long").alias("rank"))


@query(f"""
WITH p AS (SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE first_seen END AS seen FROM {POSTINGS})
SELECT id, coalesce(seen::DATE::VARCHAR, '-') AS day FROM (SELECT * FROM p WHERE seen < TIMESTAMP '1998-01-01' OR (seen = TIMESTAMP '1998-01-01' AND id > 500) OR seen IS NULL ORDER BY seen DESC NULLS LAST, id LIMIT 50)""")
def srt_09_keyset_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-08/09: the next rows after a cursor where newest come first and unknown last."""
    seen = F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("first_seen"))
    at = F.lit("1998-01-01").cast("timestamp_ntz")
    p = postings(spark, sf_dir).select("id", seen.alias("seen"))
    after = p.where((F.col("seen") < at) | ((F.col("seen") == at) & (F.col("id") > 500)) | F.col("seen").isNull())
    return facets.top(after, [F.desc_nulls_last("seen"), F.asc("id")], 50).select("id", F.coalesce(F.col("seen").cast("date").cast("string"), F.lit("-")).alias("day"))


@query(f"""
WITH n AS (SELECT c.place_id, count(*) AS n FROM {POSTINGS} p JOIN {COMPANIES} c USING (company_id) WHERE is_active GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, place_id) AS rank FROM n)
SELECT place_id, n, rank FROM r WHERE rank > 5 AND rank <= 10""")
def srt_11_cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-11: a cursor page of places by rank; the ranked facet is small and bounded by the places."""
    n = postings(spark, sf_dir).where("is_active").join(companies(spark, sf_dir), "company_id").groupBy("place_id").agg(F.count("*").alias("n"))
    r = n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "place_id")).cast("long"))
    return r.where("rank > 5 AND rank <= 10").select("place_id", "n", "rank")


@query(f"""SELECT id, (SELECT count(*) FROM {POSTINGS} WHERE is_active) > 15 AS truncated FROM (SELECT id FROM {POSTINGS} WHERE is_active ORDER BY salary DESC, id LIMIT 15)""")
def srt_12_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-12: a capped list that says whether it was cut; one row more is read than shown."""
    rows = facets.top(postings(spark, sf_dir).where("is_active"), [F.desc("salary"), F.asc("id")], 16)
    w = Window.orderBy(F.desc("salary"), "id")
    numbered = rows.select("id", F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy()).alias("n"))
    return numbered.where("r <= 15").select("id", (F.col("n") > 15).alias("truncated"))


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY first_seen DESC, id) AS rank FROM {POSTINGS} WHERE is_active),
g AS (SELECT company_id, max(first_seen) AS best FROM {POSTINGS} WHERE is_active GROUP BY 1)
SELECT r.company_id, r.id, r.rank::INTEGER AS rank, best::DATE::VARCHAR AS best FROM r JOIN g USING (company_id) WHERE rank <= 10""")
def win_04_top_hits_per_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04/05: the first 10 hits of each company and the best of the group."""
    p = postings(spark, sf_dir).where("is_active").select("company_id", "id", "first_seen")
    ranked = facets.group_top(p, "company_id", [F.desc("first_seen"), F.asc("id")], 10)
    best = F.max("first_seen").over(Window.partitionBy("company_id"))
    return ranked.select("company_id", "id", "rank", best.cast("date").cast("string").alias("best"))


@query(f"""SELECT p.id, c.name AS company, c.industry, strftime(p.first_seen, '%Y-%m-%d') AS first_seen, p.status FROM {POSTINGS} p JOIN {COMPANIES} c USING (company_id) WHERE p.id IN (1, 17, 256)""")
def prj_04_posting_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-04: a point lookup with its company."""
    p = postings(spark, sf_dir).where(F.col("id").isin(1, 17, 256))
    return p.join(companies(spark, sf_dir).withColumnRenamed("name", "company"), "company_id").select("id", "company", "industry", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), "status")


@query("""SELECT event_id, coalesce(k::VARCHAR || ' / ' || event_type, 'x') AS label, CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' END AS code
FROM (SELECT event_id, event_type, (props ->> '$.k')::BIGINT AS k FROM events)""")
def prj_05_field_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-05: paths, concatenation with constants, and map lookup."""
    k = F.get_json_object("props", "$.k")
    code = F.try_element_at(F.create_map(F.lit("click"), F.lit("C"), F.lit("view"), F.lit("V")), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.concat(k, F.lit(" / "), "event_type"), F.lit("x")).alias("label"), code.alias("code"))


@query(f"""
SELECT company_id, hits, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids FROM
 (SELECT *, count(*) OVER (PARTITION BY company_id) AS hits, row_number() OVER (PARTITION BY company_id ORDER BY first_seen DESC, id) AS rank FROM {POSTINGS} WHERE is_active)
WHERE rank <= 3 GROUP BY 1, 2""")
def prj_02_grouped_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-02: grouped hits as one row a company."""
    w = Window.partitionBy("company_id")
    p = postings(spark, sf_dir).where("is_active").withColumn("hits", F.count("*").over(w))
    ranked = facets.group_top(p, "company_id", [F.desc("first_seen"), F.asc("id")], 3)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"].cast("string"))
    return ranked.groupBy("company_id", "hits").agg(F.array_join(ids, ",").alias("ids"))


@query(f"SELECT p_partkey, array_to_string(list_concat(list_filter(words, lambda w: w IN ('steel', 'widget')), list_filter(words, lambda w: w NOT IN ('steel', 'widget'))), ' ') AS words FROM {_TOKENS}")
def prj_03_matches_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-03: values that match the filter first, both parts in their order."""
    hit = lambda w: w.isin("steel", "widget")
    return _tokens(spark, sf_dir).select("p_partkey", F.array_join(F.concat(F.filter("words", hit), F.filter("words", lambda w: ~hit(w))), " ").alias("words"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE coalesce(lang, 'en') END AS merged, CASE WHEN doc_id % 5 = 0 THEN 'default' ELSE source END AS filled FROM documents")
def prj_07_merge_and_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-07/08: fallback merge of fields, and defaults where a field is null."""
    first = F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    given = F.when(F.col("doc_id") % 5 != 0, F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(first, F.col("lang"), F.lit("en")).alias("merged"), F.when(given.isNull(), F.lit("default")).otherwise(given).alias("filled"))


@query("SELECT p_partkey, array_to_string(w, '|') AS locales FROM (SELECT p_partkey, list_distinct(['a']) AS d, CASE WHEN p_type = 'SMALL' THEN ['en', 'de'] WHEN p_type = 'LARGE' THEN ['de', 'en'] ELSE ['en', 'fr', 'de'] END AS w FROM part)")
def prj_10_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-09/10: primary (default en), then keys, then detected; each once, in order."""
    primary = F.coalesce(F.when(F.col("p_type") == "LARGE", F.lit("de")), F.lit("en"))
    keys = F.when(F.col("p_type").isin("SMALL", "LARGE"), F.array(F.lit("en"))).otherwise(F.array(F.lit("fr"), F.lit("en")))
    detected = F.array(F.lit("de"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_distinct(F.concat(F.array(primary), keys, detected)), "|").alias("locales"))


@query(f"SELECT industry, CASE WHEN place_id < 5 THEN 'near' ELSE 'far' END AS reach, count(*) AS n, sum(balance::DECIMAL(18,2))::DOUBLE AS balance FROM {COMPANIES} GROUP BY 1, 2")
def agg_30_impact_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-30/31: impact buckets with exact sums."""
    reach = F.when(F.col("place_id") < 5, "near").otherwise("far")
    return companies(spark, sf_dir).groupBy("industry", reach.alias("reach")).agg(F.count("*").alias("n"), total("balance").alias("balance"))
