"""Ingest, publish and dataset planes, and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import composed, dataset, ingest, merge, publish
from ..registry import query
from ..tables import COMPANIES, POSTINGS, companies, postings, table

# --- ingest ---------------------------------------------------------------------------

@query("""
WITH d AS (SELECT DISTINCT user_id AS u, user_id % 7 + CASE WHEN user_id % 6 = 1 THEN 1 ELSE 0 END AS board FROM events WHERE user_id % 2 = 0 OR user_id % 5 = 4),
x AS (SELECT DISTINCT user_id AS u, user_id % 7 AS owner, user_id % 3 <> 0 AS live FROM events WHERE user_id % 5 <> 4)
SELECT CASE WHEN owner IS NULL THEN 'new' WHEN owner = board AND live THEN 'touched' WHEN owner = board THEN 'relisted' WHEN live THEN 'foreign' ELSE 'foreign_relisted' END AS action, count(*) AS n FROM d LEFT JOIN x USING (u) GROUP BY 1""")
def str_02_five_way_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02: new, touched, relisted, foreign and foreign_relisted rows of a batch."""
    u = F.col("user_id")
    e = table(spark, sf_dir, "events")
    found = e.where((u % 2 == 0) | (u % 5 == 4)).select(u.cast("string").alias("url"), (u % 7 + (u % 6 == 1).cast("int")).alias("board_id"))
    stored = e.where(u % 5 != 4).select(u.cast("string").alias("url"), (u % 7).alias("board_id"), (u % 3 != 0).alias("is_active")).distinct()
    return ingest.diff(found, stored).groupBy("action").agg(F.count("*").alias("n"))


@query("""
WITH x AS (SELECT o_orderkey AS id, o_orderkey % 9 <> 0 AS live, (o_orderkey % 4)::INTEGER AS misses, o_orderkey % 3 = 0 AS rich FROM orders), s AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 40)
SELECT CASE WHEN s.id IS NOT NULL THEN TRUE ELSE live AND (CASE WHEN live THEN misses + 1 ELSE misses END) < (CASE WHEN rich THEN 1 ELSE 4 END) END AS is_active,
 (CASE WHEN s.id IS NOT NULL THEN 0 WHEN live THEN misses + 1 ELSE misses END)::INTEGER AS missing_count, count(*) AS n FROM x LEFT JOIN s USING (id) GROUP BY 1, 2""")
def str_03_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03/04: misses counted, rows ended at their board's threshold."""
    i = F.col("o_orderkey")
    stored = table(spark, sf_dir, "orders").select(i.alias("url"), (i % 9 != 0).alias("is_active"), (i % 4).cast("int").alias("missing_count"), (i % 3 == 0).alias("rich"))
    seen = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("url"))
    out = ingest.soft_delete(stored, seen, ingest.delist_threshold(F.col("rich"), F.lit(None).cast("int")))
    return out.groupBy("is_active", "missing_count").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2),
w AS (SELECT *, median(n) OVER p AS m, count(*) OVER p AS h FROM c WINDOW p AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT user_id, day, n, m::DOUBLE AS median, coalesce(h >= 3 AND n < m * 0.7, FALSE) AS dropped FROM w""")
def str_05_drop_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05, AGG-34, WIN-10: a cycle strictly under 70 % of the median of the last five."""
    c = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    w = ingest.rolling_median(c, "user_id", "day", "n")
    return w.select("user_id", "day", "n", "median", ingest.drop_guard(F.col("n"), F.col("median"), F.col("history")).alias("dropped"))


@query(f"""
WITH b AS (SELECT company_id % 50 AS board, count(*) FILTER (is_active) AS live, count(*) FILTER (is_active AND seniority <> '1-URGENT' AND company_id % 2 = 0) AS gone, bool_or(company_id % 100 = 1) AS truncated FROM {POSTINGS} GROUP BY 1)
SELECT board, CASE WHEN truncated THEN 'no deletes' WHEN gone > live * 0.5 THEN 'skipped' ELSE 'applied' END AS outcome FROM b""")
def str_06_blast_and_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05/06: a cycle that would end more than half is skipped; a truncated one deletes nothing."""
    p = postings(spark, sf_dir)
    gone = F.col("is_active") & (F.col("seniority") != "1-URGENT") & (F.col("company_id") % 2 == 0)
    b = p.groupBy((F.col("company_id") % 50).alias("board")).agg(F.count_if("is_active").alias("live"), F.count_if(gone).alias("gone"), F.bool_or(F.col("company_id") % 100 == 1).alias("truncated"))
    return b.select("board", F.when(F.col("truncated"), "no deletes").when(ingest.blast_guard(F.col("gone"), F.col("live")), "skipped").otherwise("applied").alias("outcome"))


def _board_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"view": "success", "error": "failure", "signup": "empty", "purchase": "gone", "click": "failure"}
    outcome = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    return table(spark, sf_dir, "events").select("user_id", "event_id", outcome.alias("outcome"))


@query("""
WITH RECURSIVE log AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE event_type WHEN 'view' THEN 's' WHEN 'signup' THEN 'e' WHEN 'purchase' THEN 'g' ELSE 'f' END AS x FROM events),
ends AS (SELECT user_id, max(i) AS last FROM log GROUP BY 1),
run AS (
  SELECT user_id, 0::BIGINT AS i, 'active' AS status, 0 AS failures, 0 AS empties, 0 AS gones FROM ends
  UNION ALL
  SELECT user_id, i, CASE WHEN status = 'gone' THEN 'gone' WHEN x = 's' THEN 'active' WHEN g >= 2 OR e >= 6 THEN 'gone' WHEN g = 1 THEN 'gone_pending' WHEN f >= 5 THEN 'quarantined' WHEN e >= 3 THEN 'suspect' ELSE status END, f, e, g
  FROM (SELECT r.user_id, l.i, r.status, l.x,
    CASE l.x WHEN 'f' THEN r.failures + 1 WHEN 's' THEN 0 ELSE r.failures END AS f, CASE l.x WHEN 'e' THEN r.empties + 1 WHEN 's' THEN 0 ELSE r.empties END AS e, CASE l.x WHEN 'g' THEN r.gones + 1 ELSE 0 END AS g
    FROM run r JOIN log l ON l.user_id = r.user_id AND l.i = r.i + 1))
SELECT run.user_id, status, failures, empties FROM run JOIN ends ON run.user_id = ends.user_id AND run.i = ends.last""")
def str_07_board_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03/07/08/09: boards folded over their outcomes, stretches of a log composed: counters of empty answers, failures and gone answers, and the status they give."""
    return composed.fold(_board_log(spark, sf_dir), "user_id", F.col("event_id"), "outcome")


@query()
def str_15_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-15/20: open, refuse, probe (tests compare with a plain loop)."""
    return ingest.circuit(_board_log(spark, sf_dir), "user_id", F.col("event_id"), F.col("outcome").isin("failure", "gone"))


@query("""
WITH s AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT before, event_type AS now, count(*) AS n FROM s WHERE before IS NOT NULL AND before <> event_type GROUP BY 1, 2""")
def str_23_status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-23: allowed status changes: any to any but itself."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    s = table(spark, sf_dir, "events").select(before.alias("before"), F.col("event_type").alias("now"))
    return s.where("before <> now").groupBy("before", "now").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, ts, event_id) AS turn FROM events)
SELECT event_id, user_id, turn::INTEGER AS turn FROM r WHERE turn <= 3""")
def str_12_rate_limited_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12: claims of a tick: three a domain, the first tier first."""
    w = Window.partitionBy("user_id").orderBy(F.desc(F.col("event_type") == "purchase"), "ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("turn", F.row_number().over(w)).where("turn <= 3").select("event_id", "user_id", "turn")


@query("""
WITH l AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM events WHERE event_type IN ('click', 'view')),
s AS (SELECT user_id, count(*) FILTER (done IS NULL OR done > ts + INTERVAL 12 HOUR) AS strikes FROM l GROUP BY 1)
SELECT user_id, strikes, CASE WHEN strikes >= 20 THEN 'dead' WHEN strikes > 0 THEN 'queued' ELSE 'done' END AS state FROM s""")
def str_13_lease_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13/14: leases that ran out are strikes; after too many a task is dead."""
    l = table(spark, sf_dir, "events").where("event_type IN ('click', 'view')")
    done = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    late = F.col("done").isNull() | (F.col("done") > F.col("ts") + F.expr("INTERVAL 12 HOURS"))
    s = l.withColumn("done", done).groupBy("user_id").agg(F.count_if(late).alias("strikes"))
    return s.withColumn("state", F.when(F.col("strikes") >= 20, "dead").when(F.col("strikes") > 0, "queued").otherwise("done"))


# --- publish --------------------------------------------------------------------------

_CHANGES = f"(SELECT id, first_seen AS updated_at, status FROM {POSTINGS})"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).select("id", F.col("first_seen").alias("updated_at"), "status")


def _time(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query(f"""SELECT id, strftime(updated_at, '%Y-%m-%d') AS day FROM {_CHANGES} WHERE (updated_at > TIMESTAMP '1997-03-01' OR (updated_at = TIMESTAMP '1997-03-01' AND id > 700)) AND updated_at < TIMESTAMP '1997-06-01' ORDER BY updated_at, id LIMIT 500""")
def str_18_cdc_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-17/18, SRC-24: the next slice behind a cursor, before a commit-safe cutoff."""
    rows = publish.cdc_slice(_changes(spark, sf_dir), _time("1997-03-01"), F.lit(700), _time("1997-06-01"), 500)
    return rows.select("id", F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


@query(f"""SELECT count(*) AS n, count(*) FILTER (updated_at > TIMESTAMP '2000-01-01' OR (updated_at = TIMESTAMP '2000-01-01' AND id > 10)) AS n_first,
 count(*) FILTER (updated_at > TIMESTAMP '2000-06-01' OR (updated_at = TIMESTAMP '2000-06-01' AND id > 99)) AS n_second FROM {_CHANGES}
WHERE updated_at > TIMESTAMP '2000-01-01' OR (updated_at = TIMESTAMP '2000-01-01' AND id > 10)""")
def str_16_two_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-16: one read for two targets that stand at different cursors."""
    rows = publish.two_cursors(_changes(spark, sf_dir), (_time("2000-01-01"), F.lit(10)), (_time("2000-06-01"), F.lit(99)))
    return rows.agg(F.count("*").alias("n"), F.count_if("for_first").alias("n_first"), F.count_if("for_second").alias("n_second"))


@query(f"""
WITH l AS (SELECT id, is_active, status || seniority AS f FROM {POSTINGS}),
r AS (SELECT CASE WHEN id % 97 = 0 THEN id + 100000000 ELSE id END AS id, CASE WHEN id % 13 = 0 THEN NOT is_active ELSE is_active END AS is_active, CASE WHEN id % 17 = 0 THEN 'x' ELSE status || seniority END AS f FROM {POSTINGS})
SELECT left(sha256(coalesce(l.id, r.id)::VARCHAR), 2) AS bucket, count(*) FILTER (l.id IS NULL) AS deletes, count(*) FILTER (l.id IS NOT NULL) AS upserts FROM l FULL OUTER JOIN r ON l.id = r.id
WHERE l.id IS NULL OR r.id IS NULL OR l.is_active <> r.is_active OR l.f <> r.f GROUP BY 1""")
def str_21_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-21/22, FN-53: repairs by hash partition."""
    from .relations import _remote

    local = postings(spark, sf_dir).select("id", "is_active", F.concat("status", "seniority").alias("fingerprint"))
    r = publish.repairs(local, _remote(spark, sf_dir))
    return r.groupBy("bucket").agg(F.count_if(F.col("action") == "delete").alias("deletes"), F.count_if(F.col("action") == "upsert").alias("upserts"))


@query(f"""
SELECT p.id, c.name || ' | ' || c.industry AS company, n.n_name AS place, r.r_name AS region, [n.n_nationkey, r.r_regionkey + 1000]::VARCHAR AS ancestors, epoch(first_seen)::BIGINT AS first_seen, coalesce(floor(salary / 1000)::BIGINT, -1) AS salary_k, CASE WHEN status = 'P' THEN '_none' ELSE 'en' END AS locale
FROM {POSTINGS} p JOIN {COMPANIES} c USING (company_id) JOIN nation n ON c.place_id = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def prj_01_search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01, JOI-14: one denormalised document a posting, sentinels included."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = n.join(r, n.n_regionkey == r.r_regionkey)
    c = companies(spark, sf_dir).join(place, F.col("place_id") == F.col("n_nationkey"))
    ids = F.array("n_nationkey", F.col("r_regionkey") + 1000)
    return postings(spark, sf_dir).join(c, "company_id").select(
        "id", F.concat_ws(" | ", "name", "industry").alias("company"), F.col("n_name").alias("place"), F.col("r_name").alias("region"),
        ids.cast("string").alias("ancestors"), F.unix_timestamp(F.col("first_seen").cast("timestamp")).alias("first_seen"),
        F.coalesce(F.floor(F.col("salary") / 1000), F.lit(-1)).alias("salary_k"), F.when(F.col("status") == "P", "_none").otherwise("en").alias("locale"),
    )


@query(f"SELECT id, CASE WHEN id % 5 = 0 THEN '2001-08-02' ELSE strftime(first_seen, '%Y-%m-%d') END AS updated FROM {POSTINGS}")
def str_19_change_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-19: the change time moves only with an exported column."""
    changed = F.when(F.col("id") % 5 == 0, F.lit("X")).otherwise(F.col("status")) != F.col("status")
    day = F.date_format("first_seen", "yyyy-MM-dd")
    return postings(spark, sf_dir).select("id", publish.stamped(day, F.lit("2001-08-02"), changed).alias("updated"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (1, 2, 3)")
def snk_05_guarded_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05: a prune that refuses to remove too much."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    small = publish.guarded_prune(p, p.where("p_partkey IN (1, 2, 3)"), "p_partkey", 50, 0.5)
    return publish.guarded_prune(small, p.where("p_partkey % 2 = 0"), "p_partkey", 50, 0.01)


# --- merges ---------------------------------------------------------------------------

_NEW = "(SELECT c_custkey + 1000 AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'new ' || c_name END AS c_name, c_acctbal FROM customer)"


def _new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).alias("c_custkey"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("new "), "c_name")).alias("c_name"), "c_acctbal")


@query(f"SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT * FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = n.c_custkey)")
def dml_01_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-01/02: insert where the key is absent."""
    return merge.insert_absent(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), _new_rows(spark, sf_dir), ["c_custkey"])


@query(f"SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, coalesce(n.c_name, c.c_name) AS c_name, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c FULL OUTER JOIN {_NEW} n USING (c_custkey)")
def dml_04_upsert_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-03/04/11/12, SNK-01/02: upsert in which null keeps what is stored."""
    return merge.upsert(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), _new_rows(spark, sf_dir), ["c_custkey"])


@query("""
WITH c AS (SELECT o_orderkey AS id, o_orderstatus AS cfg, (o_orderkey % 6)::INTEGER AS failures FROM orders), n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'Z' ELSE o_orderstatus END AS cfg FROM orders WHERE o_orderkey % 2 = 0)
SELECT id, coalesce(n.cfg, c.cfg) AS cfg, CASE WHEN n.cfg IS NOT NULL AND n.cfg IS DISTINCT FROM c.cfg THEN 0 ELSE failures END::INTEGER AS failures FROM c LEFT JOIN n USING (id)""")
def dml_05_reset_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-05/06/08: state starts anew only where the configuration changed."""
    i = F.col("o_orderkey")
    stored = table(spark, sf_dir, "orders").select(i.alias("id"), F.col("o_orderstatus").alias("cfg"), (i % 6).cast("int").alias("failures"))
    new = table(spark, sf_dir, "orders").where(i % 2 == 0).select(i.alias("id"), F.when(i % 4 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("cfg"))
    return merge.update_where(stored, new, ["id"], {"cfg": F.col("n.cfg"), "failures": F.lit(0)}, ~F.col("n.cfg").eqNullSafe(F.col("t.cfg")))


@query("SELECT page_id, url, page_id % 3 <> 0 AND page_id % 2 = 0 AS enabled FROM pages")
def dml_07_disable_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-07, JOI-11: rows that the registry no longer holds are disabled."""
    p = table(spark, sf_dir, "pages")
    registry = p.where("page_id % 2 = 0").select("page_id", F.lit(True).alias("listed"))
    return p.join(registry, "page_id", "left").select("page_id", "url", ((F.col("page_id") % 3 != 0) & F.coalesce("listed", F.lit(False))).alias("enabled"))


@query("SELECT user_id, event_type FROM events WHERE value > 50 GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def dml_09_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-09: on after an odd number of toggles."""
    return merge.toggled(table(spark, sf_dir, "events").where("value > 50"), ["user_id", "event_type"])


@query("SELECT user_id + 1000 AS list_id, event_id AS member, TRUE AS copied FROM events WHERE user_id = 7 AND event_type = 'view' UNION ALL SELECT user_id, event_id, FALSE FROM events WHERE user_id = 7 AND event_type = 'view'")
def dml_10_copy_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-10: a list and its members copied."""
    own = table(spark, sf_dir, "events").where("user_id = 7 AND event_type = 'view'").select(F.col("user_id").alias("list_id"), F.col("event_id").alias("member"), F.lit(False).alias("copied"))
    return own.unionByName(own.select((F.col("list_id") + 1000).alias("list_id"), "member", F.lit(True).alias("copied")))


@query("""SELECT failed, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN NOT coalesce(c_acctbal >= 0, FALSE) THEN 'balance' END, CASE WHEN NOT coalesce(c_mktsegment <> 'FURNITURE', FALSE) THEN 'segment' END) AS failed FROM customer) WHERE failed <> '' GROUP BY 1""")
def snk_03_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03/04: rows that fail a check go to a reject table with the reasons."""
    _, bad = merge.split_rejects(table(spark, sf_dir, "customer"), {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "FURNITURE"})
    return bad.groupBy(F.array_join("failed", ",").alias("failed")).agg(F.count("*").alias("n"))


# --- dataset --------------------------------------------------------------------------

_UNIT = "((('0x' || left(sha256('7|' || doc_id), 12))::BIGINT::DOUBLE + 1) / 281474976710658.0)"


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_UNIT}, doc_id) AS r FROM documents) WHERE r = 1")
def smp_01_one_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP-01/03: one seeded draw a source."""
    draw = F.struct(dataset.hashed_unit(F.lit(7), F.col("doc_id")), "doc_id")
    return dataset.one_per_group(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", draw)


@query(f"""
WITH n AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL), w AS (SELECT doc_id, least(4.0, sqrt(max(n) OVER () / n)) AS w FROM n)
SELECT doc_id, round(w, 6) AS weight FROM w ORDER BY -ln(1 - {_UNIT}) / w, doc_id LIMIT 100""")
def smp_02_weighted_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP-02, FN-64: a weighted sample of 100 in which rare languages weigh more (a sampling operator)."""
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "lang")
    n = docs.groupBy("lang").agg(F.count("*").alias("n"))
    n = n.crossJoin(F.broadcast(n.agg(F.max("n").alias("most")))).select("lang", dataset.rarity(F.col("n"), F.col("most")).alias("w"))
    u = dataset.hashed_unit(F.lit(7), F.col("doc_id"))
    drawn = docs.join(n, "lang").orderBy(dataset.clock(u, F.col("w")), "doc_id").limit(100)
    return drawn.select("doc_id", F.round("w", 6).alias("weight"))


@query("""
WITH x AS (SELECT doc_id, concat_ws(',', CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN n_chars > 20000 THEN 'long' END, CASE WHEN regexp_matches(text, '[0-9]{12}') THEN 'digits' END, CASE WHEN lang IS NULL THEN 'lang' END, CASE WHEN contains(text, 'License') THEN 'licence' END, CASE WHEN NOT contains(text, '.') THEN 'sentence' END, CASE WHEN regexp_matches(text, '[%$&*#]{3}') THEN 'noise' END) AS failed FROM documents)
SELECT doc_id, failed = '' AS accepted, failed FROM x""")
def qa_01_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-01: seven rules; a row is accepted if none fails."""
    t, n = F.col("text"), F.col("n_chars")
    rules = {"short": n >= 100, "long": n <= 20_000, "digits": ~t.rlike("[0-9]{12}"), "lang": F.col("lang").isNotNull(), "licence": ~t.contains("License"), "sentence": t.contains("."), "noise": ~t.rlike("[%$&*#]{3}")}
    accepted, failed = dataset.verdict(rules)
    return table(spark, sf_dir, "documents").select("doc_id", accepted.alias("accepted"), failed.alias("failed"))


@query("SELECT l_orderkey, count(*) = count(DISTINCT l_linenumber) AND max(l_linenumber) - min(l_linenumber) = count(*) - 1 AS contiguous, count(*) AS n FROM lineitem GROUP BY 1")
def qa_02_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-02: block numbers of a section run without gaps or repeats."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("ids"))
    return lines.select("l_orderkey", dataset.contiguous(F.col("ids")).alias("contiguous"), F.size("ids").cast("long").alias("n"))


@query("SELECT source, count(*) FILTER (contains(text, 'License')) AS dropped, count(*) FILTER (NOT contains(text, 'License')) AS kept FROM documents GROUP BY 1")
def qa_05_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-05: what a scrub would keep and drop in each partition."""
    hit = F.col("text").contains("License")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(hit).alias("dropped"), F.count_if(~hit).alias("kept"))


@query("SELECT doc_id FROM documents WHERE lower(source) NOT IN ('src1', 'src2') OR source IS NULL")
def qa_06_opt_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-06, SNK-06: sources that opted out leave the published set."""
    out = spark.createDataFrame([("SRC1",), ("Src2",)], "slug string").select(F.lower("slug").alias("slug"))
    docs = table(spark, sf_dir, "documents")
    return docs.join(out, F.lower("source") == F.col("slug"), "left_anti").select("doc_id")


@query("""
WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lang ELSE coalesce(lang, 'en') END AS a, CASE WHEN doc_id % 6 = 0 THEN 'xx' ELSE lang END AS b FROM documents)
SELECT CASE WHEN a IS NOT DISTINCT FROM b THEN 'same' WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'lost' ELSE 'changed' END AS class, count(*) AS n FROM x GROUP BY 1""")
def qa_11_reprocess_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-04/10/11/12: what a new extraction run changes."""
    a = F.when(F.col("doc_id") % 4 == 0, F.col("lang")).otherwise(F.coalesce("lang", F.lit("en")))
    b = F.when(F.col("doc_id") % 6 == 0, "xx").otherwise(F.col("lang"))
    kind = F.when(a.eqNullSafe(b), "same").when(a.isNull(), "added").when(b.isNull(), "lost").otherwise("changed")
    return table(spark, sf_dir, "documents").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT n_nationkey, n_name, n_regionkey + CASE WHEN n_nationkey % 9 = 4 THEN 50 ELSE 0 END AS rk FROM nation)
SELECT 'missing region' AS problem, n_nationkey::BIGINT AS id FROM p WHERE rk NOT IN (SELECT r_regionkey FROM region)
UNION ALL SELECT 'duplicate type' AS problem, min(p_partkey) FROM part GROUP BY p_brand, p_type, p_size, p_name HAVING count(*) > 1""")
def qa_07_registry_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-07: references that lead nowhere, and repeated entries."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + F.when(F.col("n_nationkey") % 9 == 4, 50).otherwise(0)).alias("r_regionkey"))
    lost = n.join(table(spark, sf_dir, "region"), "r_regionkey", "left_anti").select(F.lit("missing region").alias("problem"), "id")
    twice = table(spark, sf_dir, "part").groupBy("p_brand", "p_type", "p_size", "p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("id")).where("n > 1")
    return lost.unionByName(twice.select(F.lit("duplicate type").alias("problem"), "id"))


@query("""
WITH e AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS good, max(ts) FILTER (event_type = 'error') > max(ts) FILTER (event_type = 'view') AS ends_bad FROM events GROUP BY 1)
SELECT user_id, CASE WHEN good = 0 THEN 'dead' WHEN ends_bad AND errors > good THEN 'failing' WHEN errors > good THEN 'shaky' ELSE 'healthy' END AS class, CASE WHEN good = 0 THEN 'retire' WHEN ends_bad AND errors > good THEN 'recheck' ELSE 'keep' END AS action FROM e""")
def qa_09_retirement_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-09: candidates to retire, with the action."""
    bad, good = F.col("event_type") == "error", F.col("event_type") == "view"
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(bad).alias("errors"), F.count_if(good).alias("good"), (F.max(F.when(bad, F.col("ts"))) > F.max(F.when(good, F.col("ts")))).alias("ends_bad"))
    failing = F.col("ends_bad") & (F.col("errors") > F.col("good"))
    kind = F.when(F.col("good") == 0, "dead").when(failing, "failing").when(F.col("errors") > F.col("good"), "shaky").otherwise("healthy")
    return e.select("user_id", kind.alias("class"), F.when(F.col("good") == 0, "retire").when(failing, "recheck").otherwise("keep").alias("action"))


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 1 WHEN p_type = 'LARGE' THEN 2 END::INTEGER AS taxonomy_id FROM part WHERE p_size < 10""")
def qa_13_miss_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-13, JOI-26: unresolved values get their id once it is known."""
    known = spark.createDataFrame([("PROMO", 1), ("LARGE", 2)], "p_type string, taxonomy_id int")
    return table(spark, sf_dir, "part").where("p_size < 10").join(known, "p_type", "left").select("p_partkey", "taxonomy_id")
