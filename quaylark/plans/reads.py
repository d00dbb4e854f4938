"""More of the read side: filters, counts, joins, orders and trees, one query for each rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import facets, filters, hierarchy, ingest
from ..registry import query
from ..tables import COMPANIES, PLACES, POSTINGS, companies, places, postings, table

_CONTENT = "(SELECT *, CASE id % 7 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS has_content FROM " + POSTINGS + ")"
_MODES = "(SELECT id, list_filter([CASE WHEN id % 2 = 0 THEN 'remote' END, CASE WHEN id % 3 = 0 THEN 'hybrid' END, CASE WHEN id % 5 = 0 THEN 'onsite' END], lambda x: x IS NOT NULL) AS modes FROM " + POSTINGS + ")"
_LISTS = "(SELECT user_id AS list_id, '{\"company_ids\":[' || string_agg(event_id::VARCHAR, ',' ORDER BY event_id) || '],\"keyword\":\"' || CASE WHEN user_id % 4 = 0 THEN 'data' ELSE '' END || '\"}' AS filters FROM events WHERE event_type = 'purchase' GROUP BY user_id)"


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id") % 7
    return postings(spark, sf_dir).withColumn("has_content", F.when(n == 0, False).when(n != 1, True))


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    found = F.array(F.when(i % 2 == 0, "remote"), F.when(i % 3 == 0, "hybrid"), F.when(i % 5 == 0, "onsite"))
    return postings(spark, sf_dir).select("id", F.filter(found, lambda x: x.isNotNull()).alias("modes"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    by = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("list_id")).agg(ids.alias("ids"))
    word = F.when(F.col("list_id") % 4 == 0, "data").otherwise("")
    return by.select("list_id", F.concat(F.lit('{"company_ids":['), "ids", F.lit('],"keyword":"'), word, F.lit('"}')).alias("filters"))


# --- filters ---------------------------------------------------------------------------


@query(f"SELECT status, count(*) AS n FROM {_CONTENT} WHERE has_content IS DISTINCT FROM FALSE GROUP BY 1")
def flt_03_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-03: delisted rows count in flows; only rows known to be without content do not."""
    return _content(spark, sf_dir).where(filters.visible()).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['plate', 'bolt'])")
def flt_04_any_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04: any of several ids in an array column."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return words.where(filters.any_of("words", ["plate", "bolt"])).select("p_partkey")


@query(f"SELECT seniority, count(*) AS n FROM {POSTINGS} WHERE seniority IN ('1-URGENT', '5-LOW') GROUP BY 1")
def flt_05_one_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05: any of several scalar values."""
    return facets.facet(postings(spark, sf_dir).where(filters.one_of("seniority", ["1-URGENT", "5-LOW"])), "seniority")


@query(f"SELECT id FROM {_MODES} WHERE list_has_any(modes, ['remote', 'hybrid'])")
def flt_06_work_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06: any of the work modes; rows of unknown mode do not match."""
    return _modes(spark, sf_dir).where(filters.any_of("modes", ["remote", "hybrid"])).select("id")


@query(f"""SELECT 'low only' AS bounds, count(*) FILTER (salary >= 300000 AND salary <= 999999) AS n FROM {POSTINGS} UNION ALL SELECT 'high only', count(*) FILTER (salary BETWEEN 0 AND 100000) FROM {POSTINGS}
 UNION ALL SELECT 'both', count(*) FILTER (salary BETWEEN 100000 AND 300000) FROM {POSTINGS} UNION ALL SELECT 'none', count(*) FROM {POSTINGS}""")
def flt_07_salary_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07: inclusive bounds with defaults; without a bound above 0 the clause is left out. One pass counts all four."""
    kinds = {"low only": (300_000, None), "high only": (None, 100_000), "both": (100_000, 300_000), "none": (0, 0)}
    counts = [F.struct(F.lit(k).alias("bounds"), F.count_if(filters.salary_between("salary", *b)).alias("n")) for k, b in kinds.items()]
    return postings(spark, sf_dir).agg(F.array(*counts).alias("c")).select(F.inline("c"))


@query(f"SELECT list_id FROM {_LISTS} WHERE json_array_length(filters, '$.company_ids') < 12 AND coalesce(filters ->> '$.keyword', '') = ''")
def flt_19_trivial_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-19: lists that say little: fewer than twelve companies and no keyword."""
    few = F.json_array_length(F.get_json_object("filters", "$.company_ids")) < 12
    return _lists(spark, sf_dir).where(few & (F.coalesce(F.get_json_object("filters", "$.keyword"), F.lit("")) == "")).select("list_id")


@query(f"SELECT filters ->> '$.keyword' AS keyword, count(*) AS lists, sum(json_array_length(filters, '$.company_ids'))::BIGINT AS members FROM {_LISTS} GROUP BY 1 HAVING sum(json_array_length(filters, '$.company_ids')) >= 10")
def flt_21_having_json_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-21: groups kept by the length of a JSON array."""
    n = F.json_array_length(F.get_json_object("filters", "$.company_ids"))
    by = _lists(spark, sf_dir).groupBy(F.get_json_object("filters", "$.keyword").alias("keyword"))
    return by.agg(F.count("*").alias("lists"), F.sum(n).alias("members")).where("members >= 10")


# --- joins -----------------------------------------------------------------------------

_FOUND = "(SELECT DISTINCT 'u/' || l_orderkey AS url, l_returnflag AS flag FROM lineitem WHERE l_quantity > 45)"
_KNOWN = "(SELECT 'u/' || o_orderkey AS url, o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0)"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("u/"), "l_orderkey").alias("url"), F.col("l_returnflag").alias("flag")).distinct()


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 != 0").select(F.concat(F.lit("u/"), "o_orderkey").alias("url"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


@query(f"SELECT k.id, f.flag, k.status FROM {_FOUND} f JOIN {_KNOWN} k USING (url)")
def joi_02_found_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-02: found rows that are stored already, by URL."""
    return _found(spark, sf_dir).join(_known(spark, sf_dir), "url").select("id", "flag", "status")


@query(f"SELECT id FROM {_KNOWN} WHERE url NOT IN (SELECT url FROM {_FOUND})")
def joi_04_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-04: stored rows that were not found again (URLs are never null)."""
    return _known(spark, sf_dir).join(_found(spark, sf_dir), "url", "left_anti").select("id")


@query("""
WITH old AS (SELECT l_partkey AS a, l_suppkey AS b, l_linenumber AS c FROM lineitem WHERE l_returnflag = 'R'), now AS (SELECT l_partkey AS a, l_suppkey AS b, l_linenumber AS c FROM lineitem WHERE l_returnflag = 'N')
SELECT DISTINCT a, b, c FROM old WHERE NOT EXISTS (SELECT 1 FROM now WHERE now.a = old.a AND now.b = old.b AND now.c = old.c)""")
def joi_05_stale_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-05: rows whose three keys the new set lacks."""
    keys = [F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_linenumber").alias("c")]
    of = lambda flag: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(*keys).distinct()
    return of("R").join(of("N"), ["a", "b", "c"], "left_anti")


@query("""SELECT n_nationkey AS id, (SELECT p_name FROM part WHERE p_partkey % 25 = n_nationkey ORDER BY length(p_name), p_name, p_partkey LIMIT 1) AS parent_name FROM nation""")
def joi_09_lateral_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-09, WIN-06: one display name a row, the shortest, or null; an aggregate in place of a lateral join."""
    names = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 25).alias("n_nationkey")).agg(F.min_by("p_name", F.struct(F.length("p_name"), "p_name", "p_partkey")).alias("parent_name"))
    return table(spark, sf_dir, "nation").join(names, "n_nationkey", "left").select(F.col("n_nationkey").alias("id"), "parent_name")


@query("SELECT o_orderkey AS id, coalesce(c_custkey, o_custkey) AS company_id FROM orders LEFT JOIN (SELECT c_custkey, c_custkey + 7 AS renamed FROM customer WHERE c_mktsegment = 'BUILDING') r ON o_custkey = renamed")
def joi_11_realign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-11, DML-06: rows of a renamed company move to the new key."""
    renamed = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("new"), (F.col("c_custkey") + 7).alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(renamed, "o_custkey", "left").select(F.col("o_orderkey").alias("id"), F.coalesce("new", "o_custkey").alias("company_id"))


@query(f"SELECT company_id, coalesce(p.name, 'Unknown') AS place, coalesce(r.name, '') AS region FROM {COMPANIES} c LEFT JOIN (SELECT * FROM {PLACES} WHERE id % 3 <> 0) p ON c.place_id = p.id LEFT JOIN {PLACES} r ON p.parent_id = r.id")
def joi_14_names_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-14: names from dimensions, with a default where an id has none."""
    p = places(spark, sf_dir)
    own = p.where("id % 3 != 0").select(F.col("id").alias("place_id"), F.col("name").alias("place"), "parent_id")
    up = p.select(F.col("id").alias("parent_id"), F.col("name").alias("region"))
    return companies(spark, sf_dir).join(own, "place_id", "left").join(up, "parent_id", "left").select("company_id", F.coalesce("place", F.lit("Unknown")).alias("place"), F.coalesce("region", F.lit("")).alias("region"))


@query("""
WITH page AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 50 OFFSET 20)
SELECT id, count(o_orderkey) AS interviews FROM page LEFT JOIN orders ON o_custkey = id GROUP BY 1""")
def joi_16_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-16: counts for the rows of one page only, 0 where there are none."""
    page = facets.top(table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), [F.asc("id")], 50, 20)
    counts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).join(page, "id", "left_semi").groupBy("id").agg(F.count("*").alias("interviews"))
    return facets.with_zeros(page, counts, "id", ["interviews"])


@query("SELECT o_orderkey AS id, coalesce(n, 0) AS rounds, coalesce(last, 0) AS last_round FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) ON o_orderkey = l_orderkey")
def joi_17_preaggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-17: details are aggregated before the join, so no row is multiplied."""
    rounds = table(spark, sf_dir, "lineitem").where("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("rounds"), F.max("l_linenumber").alias("last_round"))
    return facets.with_zeros(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), rounds, "id", ["rounds", "last_round"])


@query("""
WITH c AS (SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS host, url FROM pages), r AS (SELECT DISTINCT host FROM c WHERE page_id % 4 = 0), u AS (SELECT url FROM c WHERE page_id % 8 = 0)
SELECT page_id, CASE WHEN url IN (SELECT url FROM u) THEN 'hard' WHEN host IN (SELECT host FROM r) THEN 'soft' ELSE 'new' END AS evidence FROM c""")
def joi_19_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-19: candidates against a registry: same URL is hard evidence, same host soft."""
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    c = table(spark, sf_dir, "pages").select("page_id", "url", host.alias("host"))
    hard = c.where("page_id % 8 = 0").select("url", F.lit(True).alias("hard")).distinct()
    soft = c.where("page_id % 4 = 0").select("host", F.lit(True).alias("soft")).distinct()
    evidence = F.when(F.col("hard"), "hard").when(F.col("soft"), "soft").otherwise("new")
    return c.join(hard, "url", "left").join(soft, "host", "left").select("page_id", evidence.alias("evidence"))


@query(f"SELECT list_id, e.event_type, count(*) AS n FROM (SELECT list_id, unnest(from_json(filters -> '$.company_ids', '[\"BIGINT\"]')) AS event_id FROM {_LISTS}) JOIN events e USING (event_id) WHERE e.value > 50 GROUP BY 1, 2")
def joi_21_unnested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-21: members of a JSON array joined with their rows."""
    ids = F.from_json(F.get_json_object("filters", "$.company_ids"), "array<bigint>")
    members = _lists(spark, sf_dir).select("list_id", F.explode(ids).alias("event_id"))
    return members.join(table(spark, sf_dir, "events").where("value > 50"), "event_id").groupBy("list_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id FROM customer WHERE lower(replace(c_name, '#', '-')) IN (SELECT 'customer-' || lpad((o_custkey)::VARCHAR, 9, '0') FROM orders WHERE o_totalprice > 480000)")
def joi_24_slugs_to_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-24: ids of slugs, each once."""
    wanted = table(spark, sf_dir, "orders").where("o_totalprice > 480000").select(F.concat(F.lit("customer-"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("slug"))
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("slug"))
    return own.join(wanted, "slug", "left_semi").select("id")


@query("SELECT e.event_id AS id, coalesce(o_orderstatus, e.event_type) AS state, o_orderkey IS NOT NULL AS live FROM events e LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') ON e.event_id = o_orderkey")
def joi_25_live_or_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-25: the live state of a saved row, else what was saved with it."""
    live = table(spark, sf_dir, "orders").where("o_orderstatus != 'F'").select(F.col("o_orderkey").alias("event_id"), "o_orderstatus")
    both = table(spark, sf_dir, "events").join(live, "event_id", "left")
    return both.select(F.col("event_id").alias("id"), F.coalesce("o_orderstatus", "event_type").alias("state"), F.col("o_orderstatus").isNotNull().alias("live"))


@query("""
WITH said AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS label FROM part), t AS (SELECT * FROM (VALUES ('plate', 1), ('bolt', 2), ('red', 3), ('widget', 4)) x(label, id))
SELECT said.label, t.id, count(*) AS n, t.id IS NULL AS missed FROM said LEFT JOIN t USING (label) GROUP BY 1, 2""")
def joi_26_labels_to_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-26: labels to taxonomy ids; those without one are collected with their counts."""
    ids = spark.createDataFrame([("plate", 1), ("bolt", 2), ("red", 3), ("widget", 4)], "label string, id int")
    said = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return said.join(ids, "label", "left").select("label", "id", "n", F.col("id").isNull().alias("missed"))


# --- counts ----------------------------------------------------------------------------


@query(f"SELECT count(*) AS found FROM {POSTINGS} WHERE is_active AND salary > 250000")
def agg_04_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04: how many rows match, without the rows."""
    return postings(spark, sf_dir).where("is_active AND salary > 250000").agg(F.count("*").alias("found"))


@query(f"""SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (has_content) AS with_content, count(*) FILTER (has_content IS NULL) AS unknown_content,
 count(*) FILTER (salary > 300000) AS well_paid, count(*) FILTER (is_active AND has_content AND salary > 300000) AS all_three FROM {_CONTENT}""")
def agg_06_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06: six conditional counts in one pass."""
    c = F.count_if
    return _content(spark, sf_dir).agg(F.count("*").alias("total"), c("is_active").alias("active"), c("has_content").alias("with_content"), c(F.col("has_content").isNull()).alias("unknown_content"), c(F.col("salary") > 300_000).alias("well_paid"), c(F.expr("is_active AND has_content AND salary > 300000")).alias("all_three"))


@query(f"""SELECT id, (SELECT count(*) FROM {POSTINGS} q WHERE q.company_id = p.company_id AND q.is_active AND q.id <> p.id) AS siblings, (SELECT count(*) FROM {POSTINGS} q WHERE q.company_id = p.company_id) AS total FROM {POSTINGS} p""")
def agg_08_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08: correlated counts as one grouped join: siblings are the total less the row itself."""
    p = postings(spark, sf_dir)
    n = p.groupBy("company_id").agg(F.count_if("is_active").alias("active"), F.count("*").alias("total"))
    return p.join(n, "company_id").select("id", (F.col("active") - F.col("is_active").cast("int")).alias("siblings"), "total")


@query("SELECT c_custkey AS id, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate DESC, o_orderkey), '') AS ids FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey GROUP BY 1")
def agg_10_ordered_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10: ordered ids of each group; an empty array where there are none."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("t"), "o_orderkey"))), lambda x: x["o_orderkey"])
    by = table(spark, sf_dir, "orders").where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("id")).agg(ids.alias("ids"))
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(by, "id", "left")
    return own.select("id", F.array_join(F.coalesce("ids", F.array().cast("array<bigint>")).cast("array<string>"), ",").alias("ids"))


@query(f"SELECT company_id, count(*) FILTER (is_active) AS active, count(*) FILTER (first_seen >= TIMESTAMP '1998-01-01') AS year FROM {POSTINGS} GROUP BY 1")
def agg_14_active_and_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: two counts of each company in one pass."""
    return postings(spark, sf_dir).groupBy("company_id").agg(F.count_if("is_active").alias("active"), F.count_if(F.expr("first_seen >= TIMESTAMP_NTZ '1998-01-01'")).alias("year"))


@query(f"SELECT mode, count(*) AS n FROM (SELECT unnest(modes) AS mode FROM {_MODES}) GROUP BY 1")
def agg_17_mode_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17: counts of work modes; a row counts once for each of its modes."""
    return facets.facet_array(_modes(spark, sf_dir), "modes", "mode")


@query("""
WITH f AS (SELECT p_brand AS parent, p_type AS child, count(*) AS n FROM part GROUP BY 1, 2)
SELECT left(parent, 7) AS domain, parent, child, n, sum(n) OVER (PARTITION BY parent)::BIGINT AS parent_n, sum(n) OVER (PARTITION BY left(parent, 7))::BIGINT AS domain_n FROM f""")
def agg_20_three_level_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20: counts of leaves with the sums of their parents and domains; each leaf counts once."""
    f = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("parent"), F.col("p_type").alias("child")).agg(F.count("*").alias("n")).withColumn("domain", F.substring("parent", 1, 7))
    up = lambda c: F.sum("n").over(Window.partitionBy(c))
    return f.select("domain", "parent", "child", "n", up("parent").alias("parent_n"), up("domain").alias("domain_n"))


@query(f"""
WITH n AS (SELECT c.place_id AS id, count(*) AS n FROM {POSTINGS} p JOIN {COMPANIES} c USING (company_id) WHERE salary > 400000 GROUP BY 1)
SELECT id, sum(n)::BIGINT AS n FROM (SELECT id, n FROM n UNION ALL SELECT p.parent_id, n FROM n JOIN {PLACES} p USING (id)) GROUP BY 1""")
def agg_22_summed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22: direct counts summed up the tree, by the closure of the places."""
    n = postings(spark, sf_dir).where("salary > 400000").join(companies(spark, sf_dir), "company_id").groupBy(F.col("place_id").alias("id")).agg(F.count("*").alias("n"))
    up = hierarchy.closure(places(spark, sf_dir).select("id", "parent_id"))
    return n.join(up, "id").groupBy(F.col("ancestor_id").alias("id")).agg(F.sum("n").alias("n"))


@query("SELECT user_id % 40 AS source_id, count(*) AS mirrors FROM events WHERE event_type = 'click' AND user_id % 40 <> user_id GROUP BY 1")
def agg_27_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-27: how often each list was copied."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'").withColumn("source_id", F.col("user_id") % 40)
    return e.where("source_id != user_id").groupBy("source_id").agg(F.count("*").alias("mirrors"))


@query("SELECT p_type AS family, count(*) AS total, round(100.0 * count(*) FILTER (p_size > 25) / count(*), 4)::DOUBLE AS covered FROM part GROUP BY 1")
def agg_31_coverage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-31: covered share of each family in percent."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("family")).agg(F.count("*").alias("total"), F.round(F.count_if(F.col("p_size") > 25) * 100.0 / F.count("*"), 4).cast("double").alias("covered"))


@query("""
WITH d AS (SELECT o_custkey AS board, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT board, strftime(day, '%Y-%m-%d') AS day, median(n) OVER (PARTITION BY board ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS baseline FROM d""")
def agg_34_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-34: median of the last five counts before each cycle."""
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("board"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return ingest.rolling_median(d, "board", "day", "n").select("board", F.col("day").cast("string").alias("day"), F.col("median").alias("baseline"))


@query("SELECT user_id AS id, count(*) AS requests, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events WHERE event_type = 'signup' GROUP BY 1")
def agg_37_request_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-37: requests of the same thing add up in one row."""
    return table(spark, sf_dir, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("requests"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


@query(f"SELECT count(DISTINCT company_id) AS companies FROM {POSTINGS} WHERE is_active AND seniority = '2-HIGH'")
def agg_39_matching_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-39: companies with a matching posting."""
    return postings(spark, sf_dir).where("is_active AND seniority = '2-HIGH'").agg(F.countDistinct("company_id").alias("companies"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def agg_41_unnested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-41: counts of array members, every occurrence."""
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT p_type AS leaf, count(*) AS n FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > (SELECT count(*) / 25 FROM part)) GROUP BY 1")
def agg_42_leaf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-42: counts of leaves only; brands with more parts than the mean are no leaves."""
    part = table(spark, sf_dir, "part")
    mean = part.agg((F.count("*") / 25).alias("mean"))  # one row
    wide = part.groupBy("p_brand").agg(F.count("*").alias("k")).crossJoin(mean).where("k > mean")
    return part.join(wide, "p_brand", "left_anti").groupBy(F.col("p_type").alias("leaf")).agg(F.count("*").alias("n"))


# --- windows, orders, sets -------------------------------------------------------------


@query(f"SELECT company_id, max(salary) AS best, min(id) AS first_id FROM {POSTINGS} WHERE is_active GROUP BY 1 ORDER BY best DESC, company_id LIMIT 25")
def win_05_groups_by_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05: groups in the order of their best hit (top-k)."""
    by = postings(spark, sf_dir).where("is_active").groupBy("company_id").agg(F.max("salary").alias("best"), F.min("id").alias("first_id"))
    return facets.top(by, [F.desc("best"), F.asc("company_id")], 25)


@query("SELECT c_nationkey AS id, c_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def win_07_one_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07: the first row of each id."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.min_by("c_name", F.struct((-F.col("c_acctbal")).alias("b"), "c_custkey")).alias("name"))


@query("SELECT user_id, max(event_id % 9) + 1 AS next_round FROM events GROUP BY 1")
def win_09_next_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-09: the number after the greatest one of each group."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.max(F.col("event_id") % 9) + 1).alias("next_round"))


@query(f"SELECT id, floor(salary / 50000)::BIGINT AS score, row_number() OVER (ORDER BY floor(salary / 50000) DESC, first_seen DESC, id)::INTEGER AS place FROM {POSTINGS} WHERE is_active ORDER BY place LIMIT 40")
def srt_01_relevance_then_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-01: greater score first, then newer, then the lesser id (top-k; only the k rows are numbered)."""
    rows = postings(spark, sf_dir).where("is_active").withColumn("score", F.floor(F.col("salary") / 50_000))
    first = facets.top(rows, [F.desc("score"), F.desc("first_seen"), F.asc("id")], 40)
    return first.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("first_seen"), "id")).alias("place"))


@query(f"SELECT id, salary FROM {POSTINGS} WHERE company_id % 3 = 0 OR company_id % 3 = 1 AND is_active ORDER BY salary DESC, id LIMIT 20 OFFSET 10")
def srt_04_merged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-04: one page over the union of two searches (top-k)."""
    p = postings(spark, sf_dir)
    both = p.where("company_id % 3 = 0").unionByName(p.where("company_id % 3 = 1 AND is_active")).select("id", "salary")
    return facets.top(both, [F.desc("salary"), F.asc("id")], 20, 10)


@query(f"""
WITH n AS (SELECT company_id, count(*) AS n FROM {POSTINGS} WHERE salary > 480000 GROUP BY 1)
SELECT company_id, coalesce(n, 0) AS n, row_number() OVER (ORDER BY coalesce(n, 0) > 0 DESC, coalesce(n, 0) DESC, company_id)::INTEGER AS place FROM {COMPANIES} LEFT JOIN n USING (company_id) WHERE industry = 'MACHINERY' ORDER BY place LIMIT 60""")
def srt_06_matches_before_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-06: companies with matches by their number, those without after them (top-k)."""
    n = postings(spark, sf_dir).where("salary > 480000").groupBy("company_id").agg(F.count("*").alias("n"))
    rows = facets.with_zeros(companies(spark, sf_dir).where("industry = 'MACHINERY'").select("company_id"), n, "company_id", ["n"])
    order = [(F.col("n") > 0).desc(), F.desc("n"), F.asc("company_id")]
    return facets.top(rows, order, 60).withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query("SELECT p_partkey AS id FROM part ORDER BY p_size > 45 DESC, p_size DESC, p_type <> 'SMALL' DESC, p_partkey LIMIT 30")
def srt_07_popular_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-07: featured rows first, then those copied most, then those with a description (top-k)."""
    order = [(F.col("p_size") > 45).desc(), F.desc("p_size"), (F.col("p_type") != "SMALL").desc(), F.asc("p_partkey")]
    return facets.top(table(spark, sf_dir, "part"), order, 30).select(F.col("p_partkey").alias("id"))


@query(f"SELECT id, company_id FROM (SELECT id, company_id, min(first_seen) OVER (PARTITION BY company_id) AS f, first_seen FROM {POSTINGS} WHERE salary > 470000) ORDER BY f, company_id, first_seen DESC, id LIMIT 50")
def srt_08_grouped_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-08: rows of one company together, companies by their oldest row, then the column asked for (top-k)."""
    rows = postings(spark, sf_dir).where("salary > 470000").withColumn("oldest", F.min("first_seen").over(Window.partitionBy("company_id")))
    return facets.top(rows, [F.asc("oldest"), F.asc("company_id"), F.desc("first_seen"), F.asc("id")], 50).select("id", "company_id")


@query(f"""SELECT action, count(*) AS n FROM (SELECT 'new' AS action FROM {_FOUND} WHERE url NOT IN (SELECT url FROM {_KNOWN}) UNION ALL SELECT 'touched' FROM {_FOUND} f JOIN {_KNOWN} k USING (url) WHERE status <> 'F' UNION ALL SELECT 'relisted' FROM {_FOUND} f JOIN {_KNOWN} k USING (url) WHERE status = 'F'
 UNION ALL SELECT 'gone' FROM {_KNOWN} WHERE status <> 'F' AND url NOT IN (SELECT url FROM {_FOUND}) UNION ALL SELECT 'ended' FROM {_KNOWN} WHERE status = 'F' AND url NOT IN (SELECT url FROM {_FOUND})) GROUP BY 1""")
def set_01_tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01: five tagged branches of a difference, from one full outer join."""
    f, k = _found(spark, sf_dir).withColumn("f", F.lit(True)), _known(spark, sf_dir).withColumn("k", F.lit(True))
    over = F.col("status") == "F"
    action = F.when(F.col("k").isNull(), "new").when(F.col("f").isNull(), F.when(over, "ended").otherwise("gone")).otherwise(F.when(over, "relisted").otherwise("touched"))
    return f.join(k, "url", "full_outer").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query(f"SELECT 'only found' AS part, count(*) AS n FROM (SELECT url FROM {_FOUND} EXCEPT SELECT url FROM {_KNOWN}) UNION ALL SELECT 'both', count(*) FROM (SELECT url FROM {_FOUND} INTERSECT SELECT url FROM {_KNOWN}) UNION ALL SELECT 'only known', count(*) FROM (SELECT url FROM {_KNOWN} EXCEPT SELECT url FROM {_FOUND})")
def set_03_difference_and_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-03: both differences and the overlap of two sets of ids in one pass."""
    f, k = _found(spark, sf_dir).select("url").distinct().withColumn("f", F.lit(1)), _known(spark, sf_dir).select("url").withColumn("k", F.lit(1))
    both = f.join(k, "url", "full_outer").agg(F.count_if(F.col("k").isNull()).alias("a"), F.count_if(F.expr("f = 1 AND k = 1")).alias("b"), F.count_if(F.col("f").isNull()).alias("c"))
    return both.select(F.inline(F.array(*[F.struct(F.lit(n).alias("part"), F.col(c).alias("n")) for n, c in (("only found", "a"), ("both", "b"), ("only known", "c"))])))


# --- trees -----------------------------------------------------------------------------


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers below nations below regions, with ids of their own ranges."""
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10_000).cast("bigint").alias("id"), F.col("s_nationkey").cast("bigint").alias("parent_id"))
    return places(spark, sf_dir).select(F.col("id").cast("bigint").alias("id"), F.col("parent_id").cast("bigint").alias("parent_id")).unionByName(s)


_TREE = f"""WITH RECURSIVE e AS (SELECT id::BIGINT AS id, parent_id::BIGINT AS parent_id FROM {PLACES} UNION ALL SELECT s_suppkey + 10000, s_nationkey FROM supplier),
up AS (SELECT id, id AS ancestor_id, 0 AS depth FROM e UNION ALL SELECT up.id, e.parent_id, depth + 1 FROM up JOIN e ON up.ancestor_id = e.id WHERE e.parent_id IS NOT NULL) """


@query(_TREE + "SELECT id, string_agg(ancestor_id::VARCHAR, '/' ORDER BY depth DESC) AS path FROM up GROUP BY 1")
def hie_02_root_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIE-02: ids from the root down to each node."""
    return hierarchy.root_path(_edges(spark, sf_dir)).select("id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query(_TREE + """, m AS (SELECT * FROM (VALUES (2001, 1), (2001, 2), (2002, 7)) t(macro, country))
SELECT id, id::VARCHAR || coalesce(',' || string_agg(a::VARCHAR, ',' ORDER BY a), '') AS ids FROM (SELECT id, ancestor_id AS a FROM up WHERE depth > 0 UNION SELECT id, macro FROM up JOIN m ON ancestor_id = country AND country < 1000) GROUP BY 1
 UNION ALL SELECT id, id::VARCHAR FROM e WHERE parent_id IS NULL""")
def hie_05_macros_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIE-05, HIE-10: oneself first, then sorted ancestors and the macro regions of the countries among them."""
    macros = spark.createDataFrame([(2001, 1), (2001, 2), (2002, 7)], "macro long, ancestor_id long")
    up = hierarchy.closure(_edges(spark, sf_dir))
    more = up.where("ancestor_id < 1000").join(F.broadcast(macros), "ancestor_id").select("id", F.col("macro").alias("ancestor_id"))
    by = up.select("id", "ancestor_id").unionByName(more).groupBy("id").agg(F.collect_set("ancestor_id").alias("a"))
    return by.select("id", F.array_join(hierarchy.expanded(F.array("id"), F.col("a")).cast("array<string>"), ",").alias("ids"))


@query(_TREE + "SELECT id, ancestor_id FROM up WHERE ancestor_id NOT IN (SELECT id FROM e WHERE parent_id IS NULL) AND depth > 0")
def hie_06_without_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIE-06: ancestors without the topmost level, whose ids are of another kind."""
    edges = _edges(spark, sf_dir)
    roots = edges.where("parent_id IS NULL").select(F.col("id").alias("ancestor_id"))
    return hierarchy.closure(edges).where("depth > 0").join(roots, "ancestor_id", "left_anti").select("id", "ancestor_id")


@query(_TREE + "SELECT ancestor_id AS id, count(*) AS below, max(depth) AS levels FROM (SELECT u.id, u.ancestor_id, u.depth FROM up u) GROUP BY 1")
def hie_07_descendant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIE-07: everything below each node, itself included."""
    return hierarchy.closure(_edges(spark, sf_dir)).groupBy(F.col("ancestor_id").alias("id")).agg(F.count("*").alias("below"), F.max("depth").alias("levels"))


@query(_TREE + "SELECT id FROM up WHERE ancestor_id = 1003")
def hie_08_by_ancestor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIE-08: descendants by the stored array of ancestors."""
    docs = hierarchy.closure(_edges(spark, sf_dir)).groupBy("id").agg(F.collect_set("ancestor_id").alias("ancestor_ids"))
    return docs.where(F.array_contains("ancestor_ids", F.lit(1003).cast("bigint"))).select("id")


@query(_TREE + "SELECT DISTINCT ancestor_id AS id FROM up WHERE id IN (SELECT s_suppkey + 10000 FROM supplier WHERE s_acctbal > 3000)")
def hie_09_parents_of_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIE-09: some nodes with all that stands above them, each once."""
    some = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").select((F.col("s_suppkey") + 10_000).alias("id"))
    return hierarchy.closure(_edges(spark, sf_dir)).join(some, "id", "left_semi").select(F.col("ancestor_id").alias("id")).distinct()
