"""Joins, set operations, hierarchies, windows and grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import hierarchy
from ..registry import query
from ..tables import COMPANIES, PLACES, POSTINGS, companies, places, postings, table, total

# --- joins -----------------------------------------------------------------------


@query(f"SELECT p.id, c.name, c.industry FROM {POSTINGS} p JOIN {COMPANIES} c USING (company_id)")
def joi_01_posting_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-01/02: inner equi-join; the planner broadcasts the dimension where its size allows."""
    return postings(spark, sf_dir).join(companies(spark, sf_dir), "company_id").select("id", "name", "industry")


@query(f"SELECT company_id FROM {COMPANIES} c WHERE NOT EXISTS (SELECT 1 FROM {POSTINGS} p WHERE p.company_id = c.company_id AND p.seniority = '1-URGENT' AND p.is_active)")
def joi_03_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-03/04/05: rows without a partner."""
    urgent = postings(spark, sf_dir).where("seniority = '1-URGENT' AND is_active")
    return companies(spark, sf_dir).join(urgent, "company_id", "left_anti").select("company_id")


@query(f"SELECT company_id FROM {COMPANIES} c WHERE EXISTS (SELECT 1 FROM {POSTINGS} p WHERE p.company_id = c.company_id AND p.salary > 490000)")
def joi_06_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-06/24: rows with a partner, once."""
    return companies(spark, sf_dir).join(postings(spark, sf_dir).where("salary > 490000"), "company_id", "left_semi").select("company_id")


@query(f"SELECT c.company_id, count(p.id) AS n, count(p.id) FILTER (is_active) AS active FROM {COMPANIES} c LEFT JOIN (SELECT * FROM {POSTINGS} WHERE salary > 450000) p USING (company_id) GROUP BY 1")
def joi_07_left_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-07/16/17: left join on counts made before the join, 0 where there are none."""
    n = postings(spark, sf_dir).where("salary > 450000").groupBy("company_id").agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"))
    return companies(spark, sf_dir).select("company_id").join(n, "company_id", "left").fillna(0)


@query(f"SELECT company_id, id, salary FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY first_seen DESC, id DESC) AS r FROM {POSTINGS}) WHERE r = 1")
def joi_08_lateral_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-08/09, WIN-07: the latest row of each key, as one aggregate without a sort."""
    last = F.max_by(F.struct("id", "salary"), F.struct("first_seen", "id")).alias("x")
    return postings(spark, sf_dir).groupBy("company_id").agg(last).select("company_id", "x.id", "x.salary")


@query(f"SELECT a.id, b.name AS parent FROM {PLACES} a JOIN {PLACES} b ON a.parent_id = b.id")
def joi_10_self_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-10: self-join on the parent."""
    p = places(spark, sf_dir)
    return p.alias("a").join(p.alias("b"), F.col("a.parent_id") == F.col("b.id")).select("a.id", F.col("b.name").alias("parent"))


_REMOTE = f"(SELECT CASE WHEN id % 97 = 0 THEN id + 100000000 ELSE id END AS id, CASE WHEN id % 13 = 0 THEN NOT is_active ELSE is_active END AS is_active, CASE WHEN id % 17 = 0 THEN 'x' ELSE status || seniority END AS fingerprint FROM {POSTINGS})"


def _remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A remote copy that lost, changed and gained rows."""
    i = F.col("id")
    return postings(spark, sf_dir).select(
        F.when(i % 97 == 0, i + 100_000_000).otherwise(i).alias("id"),
        F.when(i % 13 == 0, ~F.col("is_active")).otherwise(F.col("is_active")).alias("is_active"),
        F.when(i % 17 == 0, "x").otherwise(F.concat("status", "seniority")).alias("fingerprint"),
    )


@query(f"""
SELECT kind, count(*) AS n FROM (
 SELECT CASE WHEN r.id IS NULL THEN 'missing' WHEN l.id IS NULL THEN 'remote_only' WHEN l.is_active <> r.is_active THEN 'state' WHEN l.fingerprint <> r.fingerprint THEN 'payload' ELSE 'same' END AS kind
 FROM (SELECT id, is_active, status || seniority AS fingerprint FROM {POSTINGS}) l FULL OUTER JOIN {_REMOTE} r ON l.id = r.id) GROUP BY kind""")
def joi_13_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-13/SET-03: full outer diff of two snapshots."""
    return snapshot_diff(postings(spark, sf_dir).select("id", "is_active", F.concat("status", "seniority").alias("fingerprint")), _remote(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


def snapshot_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(id, kind) of snapshots (id, is_active, fingerprint): missing, remote_only, state, payload or same."""
    both = local.alias("l").join(remote.alias("r"), F.col("l.id") == F.col("r.id"), "full_outer")
    kind = (
        F.when(F.col("r.id").isNull(), "missing")
        .when(F.col("l.id").isNull(), "remote_only")
        .when(F.col("l.is_active") != F.col("r.is_active"), "state")
        .when(F.col("l.fingerprint") != F.col("r.fingerprint"), "payload")
        .otherwise("same")
    )
    return both.select(F.coalesce("l.id", "r.id").alias("id"), kind.alias("kind"))


@query(f"""SELECT p.id, coalesce(c.name, 'unknown') AS name, coalesce(c.industry, p.seniority) AS label FROM {POSTINGS} p LEFT JOIN (SELECT * FROM {COMPANIES} WHERE company_id % 4 <> 0) c USING (company_id)""")
def joi_15_fallback_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-14/15/25: left join, falling back to the row's own fields."""
    c = companies(spark, sf_dir).where("company_id % 4 <> 0")
    return postings(spark, sf_dir).join(c, "company_id", "left").select("id", F.coalesce("name", F.lit("unknown")).alias("name"), F.coalesce("industry", "seniority").alias("label"))


@query(f"""
WITH s AS (SELECT s_suppkey AS id, s_nationkey AS place_id, floor(s_acctbal / 100)::BIGINT AS tenant FROM supplier),
c AS (SELECT company_id, place_id, floor(balance / 100)::BIGINT AS tenant FROM {COMPANIES}),
k1 AS (SELECT company_id AS id, min(company_id) AS m FROM c GROUP BY 1 HAVING count(*) = 1),
k2 AS (SELECT tenant, min(company_id) AS m FROM c GROUP BY 1 HAVING count(*) = 1),
k3 AS (SELECT tenant, place_id, min(company_id) AS m FROM c GROUP BY 1, 2 HAVING count(*) = 1)
SELECT s.id, coalesce(k2.m, k3.m, k1.m) AS company_id, CASE WHEN k2.m IS NOT NULL THEN 'tenant' WHEN k3.m IS NOT NULL THEN 'place' ELSE 'direct' END AS rule
FROM s LEFT JOIN k1 ON s.id * 3 = k1.id LEFT JOIN k2 USING (tenant) LEFT JOIN k3 ON s.tenant = k3.tenant AND s.place_id = k3.place_id""")
def joi_18_priority_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-18/19/26: the first key that matches one company only; ambiguous keys do not count."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("place_id"), F.floor(F.col("s_acctbal") / 100).alias("tenant"), (F.col("s_suppkey") * 3).alias("direct"))
    c = companies(spark, sf_dir).select("company_id", "place_id", F.floor(F.col("balance") / 100).alias("tenant"), F.col("company_id").alias("direct"))
    for name, key in (("tenant", ["tenant"]), ("place", ["tenant", "place_id"]), ("direct", ["direct"])):
        alone = c.groupBy(*key).agg(F.min("company_id").alias(f"by_{name}"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
        s = s.join(alone, key, "left")
    rule = F.when(F.col("by_tenant").isNotNull(), "tenant").when(F.col("by_place").isNotNull(), "place").otherwise("direct")
    return s.select("id", F.coalesce("by_tenant", "by_place", "by_direct").alias("company_id"), rule.alias("rule"))


@query("""
WITH q AS (SELECT * FROM (VALUES (1, 'red'), (1, 'steel'), (2, 'blue'), (3, 'nothing')) t(list_id, word)),
w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT DISTINCT list_id, p_partkey FROM w JOIN q USING (word)""")
def joi_20_array_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-20/21: overlap join as exploded equi-join, each pair once."""
    q = spark.createDataFrame([(1, "red"), (1, "steel"), (2, "blue"), (3, "nothing")], "list_id int, word string")
    w = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return w.join(q, "word").select("list_id", "p_partkey").distinct()


@query(f"""
WITH n AS (SELECT company_id, count(*) FILTER (is_active) AS a FROM {POSTINGS} GROUP BY 1)
SELECT c.industry, count(*) AS members, sum(coalesce(a, 0))::BIGINT AS active FROM {COMPANIES} c LEFT JOIN n USING (company_id) GROUP BY 1""")
def joi_22_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-22: lists of companies with their active postings."""
    n = postings(spark, sf_dir).groupBy("company_id").agg(F.count_if("is_active").alias("a"))
    return companies(spark, sf_dir).join(n, "company_id", "left").groupBy("industry").agg(F.count("*").alias("members"), F.sum(F.coalesce("a", F.lit(0))).alias("active"))


@query(f"SELECT company_id, row_number() OVER (ORDER BY company_id IN (5, 9, 700) DESC, balance DESC, company_id)::INTEGER AS position FROM (SELECT * FROM {COMPANIES} ORDER BY company_id IN (5, 9, 700) DESC, balance DESC, company_id LIMIT 20)")
def joi_23_starred_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-23: starred companies first, then the others, as one order."""
    starred = F.desc(F.col("company_id").isin(5, 9, 700))
    rows = companies(spark, sf_dir).orderBy(starred, F.desc("balance"), "company_id").limit(20)
    return rows.select("company_id", F.row_number().over(Window.orderBy(starred, F.desc("balance"), "company_id")).alias("position"))


# --- sets -------------------------------------------------------------------------


@query("""
WITH s AS (SELECT lower(source) AS k, min(doc_id) AS first FROM documents GROUP BY 1)
SELECT k, first, row_number() OVER (ORDER BY first)::INTEGER AS position FROM s""")
def set_04_ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-04: case-insensitive dedupe in the order of first appearance (as many rows as sources)."""
    s = table(spark, sf_dir, "documents").groupBy(F.lower("source").alias("k")).agg(F.min("doc_id").alias("first"))
    return s.withColumn("position", F.row_number().over(Window.orderBy("first")))


@query("""SELECT p_partkey, array_to_string(list_concat(n, list_filter(s, lambda x: x NOT IN ('red', 'blue') AND NOT list_contains(n, x))), ' ') AS merged
FROM (SELECT p_partkey, string_split(p_name, ' ') AS n, string_split(p_name || ' ' || lower(p_type) || ' red', ' ') AS s FROM part)""")
def set_05_merge_keeping_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-05: the new selection plus stored values that were not loaded."""
    new = F.split("p_name", " ")
    stored = F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("red")), " ")
    loaded = F.array(F.lit("red"), F.lit("blue"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_union(new, F.array_except(stored, loaded)), " ").alias("merged"))


@query("SELECT regexp_replace(url, '[?#].*$', '') AS identity, min(url) AS url, count(*) AS n FROM pages GROUP BY 1")
def set_06_identity_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-06: one URL an identity, the least one."""
    return table(spark, sf_dir, "pages").groupBy(F.regexp_replace("url", "[?#].*$", "").alias("identity")).agg(F.min("url").alias("url"), F.count("*").alias("n"))


@query(f"""SELECT 'company' AS kind, company_id AS id FROM {COMPANIES} WHERE balance > 5000 UNION ALL SELECT 'place', id FROM (SELECT DISTINCT id FROM {PLACES}) UNION ALL SELECT 'part', p_partkey FROM part WHERE p_size = 7""")
def set_02_authority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01/02: a tagged union of branches."""
    tag = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("id"))
    a = tag(companies(spark, sf_dir).where("balance > 5000"), "company", "company_id")
    b = tag(places(spark, sf_dir), "place", "id").distinct()
    return a.unionByName(b).unionByName(tag(table(spark, sf_dir, "part").where("p_size = 7"), "part", "p_partkey"))


# --- hierarchies -------------------------------------------------------------------

_CLOSURE = f"""
WITH RECURSIVE e AS (SELECT id, parent_id FROM {PLACES} UNION ALL SELECT company_id + 100000, place_id FROM {COMPANIES}),
up(id, ancestor_id, depth) AS (SELECT id, id, 0 FROM e UNION ALL SELECT up.id, e.parent_id, up.depth + 1 FROM up JOIN e ON up.ancestor_id = e.id WHERE e.parent_id IS NOT NULL)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, country and company as one tree."""
    tree = places(spark, sf_dir).select(F.col("id").cast("long").alias("id"), F.col("parent_id").cast("long").alias("parent_id"))
    return tree.unionByName(companies(spark, sf_dir).select((F.col("company_id") + 100_000).alias("id"), F.col("place_id").cast("long").alias("parent_id")))


@query(_CLOSURE + " SELECT id, ancestor_id, depth FROM up")
def hie_03_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIE-02/03/06/09: ancestor closure."""
    return hierarchy.closure(_edges(spark, sf_dir))


@query(_CLOSURE + " SELECT id FROM up WHERE ancestor_id = 1002")
def hie_01_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIE-01/07/08: everything below a node."""
    return hierarchy.descendants(_edges(spark, sf_dir), 1002)


@query(_CLOSURE + """, m AS (SELECT * FROM (VALUES (2001, 1), (2001, 2), (2002, 7)) t(macro_id, country_id))
SELECT id, string_agg(a::VARCHAR, ',' ORDER BY p, a) AS ids FROM (
 SELECT id, ancestor_id AS a, CASE WHEN depth = 0 THEN 0 ELSE 1 END AS p FROM up
 UNION ALL SELECT up.id, macro_id, 1 FROM up JOIN m ON up.ancestor_id = m.country_id) GROUP BY id""")
def hie_04_ancestors_with_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIE-04/05/10: the node itself, then sorted ancestors and macro regions."""
    macros = spark.createDataFrame([(2001, 1), (2001, 2), (2002, 7)], "macro_id long, ancestor_id long")
    up = hierarchy.closure(_edges(spark, sf_dir)).select("id", "ancestor_id")
    both = up.unionByName(up.join(macros, "ancestor_id").select("id", F.col("macro_id").alias("ancestor_id")))
    ids = hierarchy.expanded(F.array("id"), F.collect_set("ancestor_id"))
    return both.groupBy("id").agg(F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query("""SELECT p_brand AS k, lang AS locale, doc_id FROM (
 SELECT p_brand, lang, doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, doc_id) AS r FROM part JOIN documents ON doc_id = p_partkey WHERE lang IS NOT NULL) WHERE r = 1""")
def hie_11_prefer_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIE-11, WIN-06: the preferred locale of each key, else English, else the first."""
    names = table(spark, sf_dir, "part").join(table(spark, sf_dir, "documents").where("lang IS NOT NULL"), F.col("doc_id") == F.col("p_partkey")).select(F.col("p_brand").alias("k"), F.col("lang").alias("locale"), "doc_id")
    return hierarchy.prefer_locale(names, "k", "fr", F.asc("doc_id"))


@query("""
WITH n AS (SELECT p_partkey AS id, replace(p_name, ' ', '-') AS slug, lower(p_type) AS t FROM part WHERE p_size <= 3)
SELECT id, CASE WHEN count(*) OVER (PARTITION BY slug) = 1 THEN slug WHEN count(*) OVER (PARTITION BY slug || '-' || t) = 1 THEN slug || '-' || t ELSE slug || '-' || t || '-' || id END AS slug FROM n""")
def hie_12_unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIE-12: the shortest slug that is unique."""
    slug = F.replace("p_name", F.lit(" "), F.lit("-"))
    longer = F.concat_ws("-", slug, F.lower("p_type"))
    rows = table(spark, sf_dir, "part").where("p_size <= 3").select(F.col("p_partkey").alias("id"), slug.alias("s"), longer.alias("l"))
    return rows.select("id", hierarchy.unique_slug(F.col("s"), F.col("l"), F.concat_ws("-", "l", F.col("id").cast("string"))).alias("slug"))


@query(f"""
SELECT r.name AS region, n.name AS country, count(DISTINCT p.id) AS postings FROM {POSTINGS} p JOIN {COMPANIES} c USING (company_id) JOIN {PLACES} n ON c.place_id = n.id JOIN {PLACES} r ON n.parent_id = r.id
WHERE is_active GROUP BY GROUPING SETS ((r.name), (r.name, n.name))""")
def agg_21_location_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21/22: region and country counts from one pass (rollup of partial sums)."""
    p = places(spark, sf_dir)
    n = p.where("kind = 'country'").select(F.col("id").alias("place_id"), F.col("name").alias("country"), F.col("parent_id"))
    r = p.where("kind = 'region'").select(F.col("id").alias("parent_id"), F.col("name").alias("region"))
    by_company = postings(spark, sf_dir).where("is_active").groupBy("company_id").agg(F.count("*").alias("n"))
    flat = by_company.join(companies(spark, sf_dir), "company_id").join(n, "place_id").join(r, "parent_id")
    return flat.rollup("region", "country").agg(F.sum("n").alias("postings")).where("region IS NOT NULL")


@query(f"""
WITH m AS (SELECT id AS country_id, id % 6 AS macro FROM {PLACES} WHERE kind = 'country'),
n AS (SELECT place_id, count(*) AS n FROM {POSTINGS} p JOIN {COMPANIES} c USING (company_id) WHERE salary > 499000 GROUP BY 1)
SELECT macro, sum(n)::BIGINT AS postings FROM m JOIN n ON place_id = country_id GROUP BY 1 HAVING count(*) >= 2""")
def agg_23_macro_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23: macro regions of which two countries or more have postings."""
    n = postings(spark, sf_dir).where("salary > 499000").join(companies(spark, sf_dir), "company_id").groupBy("place_id").agg(F.count("*").alias("n"))
    return n.groupBy((F.col("place_id") % 6).alias("macro")).agg(F.sum("n").alias("postings"), F.count("*").alias("c")).where("c >= 2").select("macro", "postings")


# --- windows -----------------------------------------------------------------------


@query("""
WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events)
SELECT event_id, user_id, rank::INTEGER AS rank FROM r ORDER BY rank, event_id LIMIT 200""")
def win_01_fair_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01/02: rank inside each key, then take turns over keys."""
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", r.alias("rank")).orderBy("rank", "event_id").limit(200)


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS round FROM lineitem WHERE l_returnflag <> 'R'")
def win_03_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03: rounds numbered anew after rows went."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).alias("round"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, event_id)) AS last_value, max(event_id) + 1 AS next_id FROM events GROUP BY 1")
def win_08_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08/09: the last value of each key, and the next number."""
    order = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", order).alias("last_type"), F.max_by("value", order).alias("last_value"), (F.max("event_id") + 1).alias("next_id"))


@query("""
WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2),
g AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INTEGER AS island FROM d)
SELECT user_id, max(len) AS streak FROM (SELECT user_id, island, count(*) AS len FROM g GROUP BY 1, 2) GROUP BY 1""")
def win_10_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-10: the longest run of days with events (gaps and islands)."""
    d = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return d.select("user_id", island.alias("island")).groupBy("user_id", "island").agg(F.count("*").alias("len")).groupBy("user_id").agg(F.max("len").alias("streak"))


# --- grouped reports ----------------------------------------------------------------


@query(f"""
WITH s AS (SELECT c.place_id, company_id, count(*) AS n, count(*) FILTER (is_active) AS a, greatest(max(date_diff('day', first_seen::DATE, DATE '2001-08-01')), 0) AS age FROM {POSTINGS} p JOIN {COMPANIES} c USING (company_id) GROUP BY 1, 2)
SELECT place_id, company_id, a AS active, sum(a) OVER (PARTITION BY place_id)::BIGINT - a AS siblings, max(age) OVER (PARTITION BY place_id) AS oldest FROM s""")
def agg_07_two_level_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07/08: per source, then per group; siblings are the group's total without the source."""
    age = F.greatest(F.max(F.datediff(F.lit("2001-08-01").cast("date"), F.col("first_seen").cast("date"))), F.lit(0)).cast("long")
    s = postings(spark, sf_dir).groupBy("company_id").agg(F.count_if("is_active").alias("active"), age.alias("age")).join(companies(spark, sf_dir), "company_id")
    w = Window.partitionBy("place_id")
    return s.select("place_id", "company_id", "active", (F.sum("active").over(w) - F.col("active")).alias("siblings"), F.max("age").over(w).alias("oldest"))


@query("SELECT user_id, string_agg(event_type || ':' || event_id, ',' ORDER BY event_type = 'purchase' DESC, ts DESC, event_id) AS history FROM events WHERE value > 100 GROUP BY 1")
def agg_09_ordered_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09/10: ordered lists, one kind first, newest first."""
    key = F.struct((F.col("event_type") != "purchase").alias("a"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("b"), F.col("event_id").alias("c"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("v"))
    rows = F.transform(F.array_sort(F.collect_list(key)), lambda r: r["v"])
    return table(spark, sf_dir, "events").where("value > 100").groupBy("user_id").agg(F.array_join(rows, ",").alias("history"))


@query("""
WITH n AS (SELECT user_id, count(*) AS rounds FROM events WHERE event_type = 'purchase' GROUP BY 1), r AS (SELECT unnest(generate_series(1, (SELECT max(rounds) FROM n))) AS round)
SELECT round::INTEGER AS round, count(*) FILTER (rounds >= round) AS reached, count(*) FILTER (rounds = round) AS ended FROM n, r GROUP BY 1""")
def agg_25_funnel_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25: how many reached a round and how many ended there, over all events and rounds: each user makes its own rounds, without a join."""
    n = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").cast("int").alias("rounds"))
    flags = n.select(F.explode(F.sequence(F.lit(1), "rounds")).alias("round"), "rounds")
    return flags.groupBy("round").agg(F.count("*").alias("reached"), F.count_if(F.col("rounds") == F.col("round")).alias("ended"))


@query("SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_26_activity_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-26: calendar days in the viewer's time zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Tokyo"), F.col("ts"))
    return table(spark, sf_dir, "events").groupBy(F.date_format(local, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT user_id % 20 AS source_id, count(*) AS mirrors, coalesce(sum(value::DECIMAL(18,2)) FILTER (ts >= TIMESTAMP '2024-01-20'), 0)::DOUBLE AS spent FROM events GROUP BY 1")
def agg_28_spend_and_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-27/28: mirrors by source, and what was spent since a day (0 where nothing)."""
    since = F.when(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"), F.col("value"))
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("source_id")).agg(F.count("*").alias("mirrors"), F.coalesce(total(since), F.lit(0.0)).alias("spent"))


@query("SELECT coalesce(CASE WHEN doc_id % 6 = 0 THEN NULL ELSE source END, 'NULL') AS slug, count(*) AS n FROM documents GROUP BY 1")
def agg_29_null_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-29: a distribution in which unknown is a value."""
    slug = F.coalesce(F.when(F.col("doc_id") % 6 != 0, F.col("source")), F.lit("NULL"))
    return table(spark, sf_dir, "documents").groupBy(slug.alias("slug")).agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT p_brand, list_sort(list(DISTINCT p_partkey)) AS s FROM part GROUP BY 1), b AS (SELECT p_brand, list_sort(list(DISTINCT p_partkey)) AS s FROM part WHERE NOT (p_brand = 'Brand#4' AND p_size < 5) GROUP BY 1)
SELECT a.p_brand, len(a.s) AS n_before, len(b.s) AS n_after FROM a JOIN b USING (p_brand) WHERE a.s <> b.s""")
def agg_32_changed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-32: keys whose sets differ between snapshots, by order-free digests."""
    p = table(spark, sf_dir, "part")
    ids = lambda df, n: df.groupBy("p_brand").agg(F.countDistinct("p_partkey").alias(n), set_digest(F.col("p_partkey")).alias(f"d_{n}"))
    both = ids(p, "n_before").join(ids(p.where("NOT (p_brand = 'Brand#4' AND p_size < 5)"), "n_after"), "p_brand")
    return both.where("d_n_before <> d_n_after").select("p_brand", "n_before", "n_after")


def set_digest(value: Column) -> Column:
    """Digest of the distinct values of a group that no order can change; nothing is gathered."""
    h = F.xxhash64(value.cast("string"))
    return F.concat_ws("/", F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h).cast("string"), F.count("*").cast("string"))


@query("""
WITH g AS (SELECT l_orderkey, l_returnflag || l_linestatus AS k, count(*) AS n, min(l_linenumber) AS first, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, k, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first, k) AS r FROM g) WHERE r = 1""")
def agg_33_mode_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-33: the most frequent group of each key (ties: seen first), with its least and greatest value."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("k")).agg(F.count("*").alias("n"), F.min("l_linenumber").alias("first"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    best = F.min_by(F.struct("k", "lo", "hi"), F.struct(-F.col("n"), "first", "k")).alias("x")
    return g.groupBy("l_orderkey").agg(best).select("l_orderkey", "x.k", "x.lo", "x.hi")


@query("SELECT sha256(string_agg(h, ',' ORDER BY h)) AS digest, count(*) AS n FROM (SELECT sha256(n_nationkey || '|' || n_name) AS h FROM nation)")
def agg_35_snapshot_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-35: digest of a bounded snapshot whatever the order of its rows."""
    h = F.sha2(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name"), 256)
    return table(spark, sf_dir, "nation").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(h)), ","), 256).alias("digest"), F.count("*").alias("n"))


@query("""SELECT event_type AS value, count(*) + CASE WHEN event_type = 'click' THEN 10 ELSE 0 END AS hits, CASE WHEN event_type = 'click' THEN 'resolved' ELSE 'pending' END AS status FROM events GROUP BY 1""")
def agg_36_hit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-36/37: counters added to what is stored; a status that is set stays."""
    stored = spark.createDataFrame([("click", 10, "resolved")], "value string, stored long, was string")
    new = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n"))
    return new.join(stored, "value", "full_outer").select("value", (F.coalesce("stored", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("hits"), F.coalesce("was", F.lit("pending")).alias("status"))


@query("""
WITH a AS (SELECT p_partkey AS k, p_size AS v FROM part), b AS (SELECT p_partkey + 20 AS k, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part)
SELECT CASE WHEN b.v IS NULL THEN 'lost' WHEN a.v IS NULL THEN 'added' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS class, count(*) AS n FROM a FULL OUTER JOIN b USING (k) GROUP BY 1""")
def agg_40_change_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-40: added, lost, changed and equal values between two runs."""
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    b = p.select((F.col("p_partkey") + 20).alias("k"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("w"))
    kind = F.when(F.col("w").isNull(), "lost").when(F.col("v").isNull(), "added").when(F.col("v") != F.col("w"), "changed").otherwise("same")
    return a.join(b, "k", "full_outer").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS worker, user_id % 3 AS tier, count(*) FILTER (ts <= TIMESTAMP '2024-01-15') AS ready, count(*) AS n FROM events GROUP BY 1, 2")
def agg_43_queue_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-43: ready and total depth of each worker type and tier."""
    ready = F.count_if(F.col("ts") <= F.lit("2024-01-15").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("worker"), (F.col("user_id") % 3).alias("tier")).agg(ready.alias("ready"), F.count("*").alias("n"))


@query("""SELECT event_type, count(*) FILTER (v % 4 = 0) AS "open", count(*) FILTER (v % 4 = 1) AS "retried", count(*) FILTER (v % 4 = 9) AS "dropped" FROM (SELECT event_type, event_id AS v FROM events) GROUP BY 1""")
def agg_44_state_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-44: type by state, cells without rows are 0."""
    state = F.when(F.col("event_id") % 4 == 0, "open").when(F.col("event_id") % 4 == 1, "retried").when(F.col("event_id") % 4 == 9, "dropped")
    return table(spark, sf_dir, "events").withColumn("state", state).groupBy("event_type").pivot("state", ["open", "retried", "dropped"]).count().fillna(0)


@query("SELECT lang AS locale, count(*) AS names, count(*) FILTER (n_chars > 500) AS display FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def agg_45_locale_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-45: display names of each locale."""
    return table(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy(F.col("lang").alias("locale")).agg(F.count("*").alias("names"), F.count_if(F.col("n_chars") > 500).alias("display"))


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part WHERE p_size > 48 GROUP BY 1 HAVING count(*) = 1")
def agg_46_single_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-46: groups of one."""
    return table(spark, sf_dir, "part").where("p_size > 48").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("n")).where("n = 1").select("p_name", "p_partkey")


@query("""
WITH o AS (SELECT user_id AS issue, min(ts) AS opened FROM events WHERE event_type = 'signup' GROUP BY 1), c AS (SELECT user_id AS issue, min(ts) AS claimed FROM events WHERE event_type = 'click' AND value > 300 GROUP BY 1)
SELECT count(*) FILTER (claimed IS NULL) AS available, round(avg(epoch_us(claimed) - epoch_us(opened)) FILTER (claimed > opened) / 1000000, 3) AS mean_s, round(max(epoch_us(claimed) - epoch_us(opened)) FILTER (claimed > opened) / 1000000, 3) AS max_s FROM o LEFT JOIN c USING (issue)""")
def srt_13_queue_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-13: what is open without a claim, and how long the first claim took."""
    e = table(spark, sf_dir, "events")
    opened = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("issue")).agg(F.min("ts").alias("opened"))
    claimed = e.where("event_type = 'click' AND value > 300").groupBy(F.col("user_id").alias("issue")).agg(F.min("ts").alias("claimed"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    took = F.when(F.col("claimed") > F.col("opened"), micros("claimed") - micros("opened"))
    return opened.join(claimed, "issue", "left").agg(F.count_if(F.col("claimed").isNull()).alias("available"), F.round(F.avg(took) / 1_000_000, 3).alias("mean_s"), F.round(F.max(took) / 1_000_000, 3).alias("max_s"))
