"""More of ingest, merges, publishing and the dataset, one query for each rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dataset, gone, ingest, merge, publish
from ..registry import query
from ..sources import readers
from ..storage import fresh_path
from ..tables import POSTINGS, postings, table

# --- sources ---------------------------------------------------------------------------


def _csv(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Rows written as CSV to the shared folder and read again, every column as text."""
    path = fresh_path(spark, name)
    rows.write.csv(path, header=True, quoteAll=True, emptyValue="")
    return readers.read_registry(spark, path)


@query("SELECT n_nationkey::VARCHAR AS slug, n_name AS name, lpad(n_regionkey::VARCHAR, 3, '0') AS code FROM nation")
def src_01_registry_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01: a registry file with every column as text, so that leading zeros stay."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("slug"), F.col("n_name").alias("name"), F.lpad(F.col("n_regionkey").cast("string"), 3, "0").alias("code"))
    return _csv(spark, n, "registry").select("slug", "name", "code")


@query("SELECT s_suppkey::VARCHAR AS board, s_nationkey::VARCHAR AS company, CASE WHEN s_acctbal > 0 THEN 'on' ELSE '' END AS config FROM supplier")
def src_02_boards_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02: the file of boards; an empty field stays an empty text."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("board"), F.col("s_nationkey").alias("company"), F.when(F.col("s_acctbal") > 0, "on").otherwise("").alias("config"))
    return _csv(spark, s, "boards").select("board", "company", F.coalesce("config", F.lit("")).alias("config"))


_FRAMES = "(SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'next' WHEN 1 THEN 'router' WHEN 2 THEN 'flight' END AS kind, page_id AS n FROM pages)"


@query(f"SELECT page_id, kind AS framework, '{{\"id\":' || n || '}}' AS payload FROM {_FRAMES} WHERE kind IS NOT NULL")
def src_13_framework_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13: page state of three frameworks, each behind its own marker."""
    state = F.concat(F.lit('{"id":'), "page_id", F.lit("}"))
    marked = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script>")))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("<script>window.__remixContext = "), state, F.lit(";</script>")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("<script>self.__next_f.push("), state, F.lit(")</script>")))
        .otherwise("<p>no state</p>")
    )
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", marked).alias("html"))
    return readers.framework_payloads(pages, "page_id", "html")


@query("""
WITH r AS (SELECT page_id, page_id % 10 AS host, CASE WHEN page_id % 3 = 0 THEN 2 * (1 + page_id % 4) WHEN page_id % 3 = 1 THEN 3 * (1 + page_id % 4) ELSE 0 END AS score FROM pages)
SELECT page_id, host, score, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id)::INTEGER AS rank FROM r WHERE score > 0""")
def src_16_array_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16: captured responses of each host, the likeliest list of postings first."""
    one = F.when(F.col("page_id") % 3 == 0, '{"title":"t"}').when(F.col("page_id") % 3 == 1, '{"title":"t","url":"u"}').otherwise('{"x":"1"}')
    body = F.concat(F.lit('{"items":['), F.array_join(F.array_repeat(one, (F.col("page_id") % 4 + 1).cast("int")), ","), F.lit("]}"))
    rows = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 10).alias("host"), body.alias("body"))
    return readers.scored_arrays(rows, "page_id", "body", "host")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS r FROM events) WHERE r <= 3 * 20")
def src_19_capped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-19: every board is read to its end, but for a cap of three pages of twenty (the cap is the feature)."""
    w = Window.partitionBy(F.col("user_id") % 8).orderBy("event_id")
    return table(spark, sf_dir, "events").withColumn("page", F.floor((F.row_number().over(w) - 1) / 20)).where("page < 3").select("event_id")


@query("SELECT event_id FROM events WHERE (ts > TIMESTAMP '2024-01-05' OR ts = TIMESTAMP '2024-01-05' AND event_id > 100) AND ts < TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 75")
def src_24_changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-24: the next rows behind a cursor of time and id, before the cutoff (top-k is the batch size)."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("updated_at"))
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return publish.cdc_slice(rows, day("2024-01-05"), F.lit(100), day("2024-01-20"), 75).select(F.col("id").alias("event_id"))


@query("""
WITH f AS (SELECT p_brand AS source, 'type' AS facet, p_type AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT p_brand, 'size', (p_size % 20)::VARCHAR, count(*) FROM part GROUP BY ALL),
g AS (SELECT source, facet, count(*) AS k, max(n) AS top FROM f GROUP BY 1, 2)
SELECT source, arg_max(facet, (k, facet)) AS facet FROM g WHERE top < (SELECT count(*) / 200 FROM part) GROUP BY 1""")
def src_25_facet_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-25: of each source the facet with most values, none of which reaches the cap."""
    part = table(spark, sf_dir, "part")
    facets = part.select(F.col("p_brand").alias("source"), F.inline(F.array(F.struct(F.lit("type").alias("facet"), F.col("p_type").alias("value")), F.struct(F.lit("size").alias("facet"), (F.col("p_size") % 20).cast("string").alias("value")))))
    cap = part.agg((F.count("*") / 200).alias("cap"))
    return readers.chosen_facet(facets.groupBy("source", "facet", "value").agg(F.count("*").alias("n")).crossJoin(cap))


@query("""
WITH RECURSIVE f AS (SELECT p_brand AS source, p_type AS value, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS i FROM part GROUP BY 1, 2),
cap AS (SELECT count(*) / 60 AS cap FROM part),
b AS (SELECT source, value, n, i, 1 AS bucket, n AS size FROM f WHERE i = 1
 UNION ALL SELECT f.source, f.value, f.n, f.i, CASE WHEN b.size + f.n >= cap THEN b.bucket + 1 ELSE b.bucket END, CASE WHEN b.size + f.n >= cap THEN f.n ELSE b.size + f.n END FROM b JOIN f ON f.source = b.source AND f.i = b.i + 1, cap)
SELECT source, value, i AS place, bucket FROM b""")
def src_26_facet_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-26: facet values of each source in their order, filled into queries below a cap."""
    part = table(spark, sf_dir, "part")
    f = part.groupBy(F.col("p_brand").alias("source"), F.col("p_type").alias("value")).agg(F.count("*").alias("n"))
    return readers.filled_buckets(f.crossJoin(part.agg((F.count("*") / 60).alias("cap"))), "source", "value", "n", "cap")


@query("""
WITH need AS (SELECT DISTINCT p_brand AS source, p_type AS value FROM part), got AS (SELECT DISTINCT p_brand AS source, p_type AS value FROM part WHERE p_size <> 1 OR p_partkey % 3 <> 0),
s AS (SELECT source, count(*) AS advertised, count(*) FILTER (EXISTS (SELECT 1 FROM got g WHERE g.source = n.source AND g.value = n.value)) AS read FROM need n GROUP BY 1)
SELECT s.source, advertised, read, CASE WHEN read = advertised THEN (SELECT count(*) FROM part WHERE p_brand = s.source AND (p_size <> 1 OR p_partkey % 3 <> 0)) END AS rows FROM s""")
def src_27_all_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-27: the union of advertised partitions; a source that lacks one of them gives no rows in this cycle."""
    part = table(spark, sf_dir, "part").withColumn("read", F.expr("p_size <> 1 OR p_partkey % 3 <> 0"))
    each = part.groupBy(F.col("p_brand").alias("source"), F.col("p_type").alias("value")).agg(F.count_if("read").alias("n"))
    by = each.groupBy("source").agg(F.count("*").alias("advertised"), F.count_if(F.col("n") > 0).alias("read"), F.sum("n").alias("rows"))
    return by.select("source", "advertised", "read", F.when(F.col("read") == F.col("advertised"), F.col("rows")).alias("rows"))


@query("""SELECT event_id, 'Job ' || event_id AS title, 'u/' || event_id AS url, CASE WHEN event_id % 3 = 0 THEN 'City ' || user_id END AS location FROM events""")
def src_30_auto_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-30: fields of a posting from an object of unknown shape, by the names its keys usually have."""
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    names = [("title", "url"), ("jobTitle", "applyUrl"), ("name", "link")]
    obj = F.lit(None).cast("string")
    for k, (t, l) in enumerate(names):
        more = F.concat(F.lit(',"city":"City '), u, F.lit('"')) if k == 0 else F.lit("")
        made = F.concat(F.lit(f'{{"{t}":"Job '), i, F.lit(f'","{l}":"u/'), i, F.lit('"'), more, F.lit("}"))
        obj = F.when(F.col("event_id") % 3 == k, made).otherwise(obj)
    return readers.auto_mapped(table(spark, sf_dir, "events").select("event_id", obj.alias("body")), "event_id", "body")


# --- sinks and merges ------------------------------------------------------------------

_HELD = "(SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS salary FROM orders WHERE o_orderkey % 4 <> 0)"
_SENT = "(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'N' END AS status, o_totalprice + 1 AS salary FROM orders WHERE o_orderkey % 4 < 2)"


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("salary"))


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey % 4 < 2")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, "N").alias("status"), (F.col("o_totalprice") + 1).alias("salary"))


@query(f"SELECT s.id, h.id IS NOT NULL AS updated, s.status IS NOT NULL AS accepted FROM {_SENT} s LEFT JOIN {_HELD} h USING (id)")
def snk_01_acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01: what became of each document of a batch: updated or inserted, accepted or not."""
    held = _held(spark, sf_dir).select("id", F.lit(True).alias("there"))
    return _sent(spark, sf_dir).join(held, "id", "left").select("id", F.coalesce("there", F.lit(False)).alias("updated"), F.col("status").isNotNull().alias("accepted"))


@query(f"SELECT id, CASE WHEN s.id IS NOT NULL THEN s.status ELSE h.status END AS status, coalesce(s.salary, h.salary) AS salary FROM {_HELD} h FULL JOIN {_SENT} s USING (id)")
def snk_02_merge_on_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02: insert, or overwrite on conflict, nulls included."""
    return merge.upsert(_held(spark, sf_dir), _sent(spark, sf_dir), ["id"], coalesce=False)


@query("""
WITH old AS (SELECT doc_id AS id, sha256(source) AS hash, doc_id % 3 = 0 AS checked FROM documents), new AS (SELECT doc_id AS id, sha256(CASE WHEN doc_id % 4 = 0 THEN source || '!' ELSE source END) AS hash FROM documents WHERE doc_id % 2 = 0)
SELECT id, coalesce(n.hash, o.hash) AS hash, CASE WHEN n.hash IS NULL OR n.hash = o.hash THEN checked ELSE FALSE END AS checked FROM old o LEFT JOIN new n USING (id)""")
def snk_04_unchanged_keeps_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04: a description with the same hash keeps its flags, a new one loses them."""
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    old = d.select(F.col("doc_id").alias("id"), F.sha2("source", 256).alias("hash"), (F.col("doc_id") % 3 == 0).alias("checked"))
    new = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("source", F.lit("!"))).otherwise(F.col("source")), 256).alias("hash"))
    same = F.col("n.hash") == F.col("t.hash")
    return merge.update_where(old, new, ["id"], {"hash": F.col("n.hash"), "checked": F.when(same, F.col("t.checked")).otherwise(False)}, F.lit(True))


@query("SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS rows FROM events WHERE value > 20 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1")
def snk_06_published_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06: accepted rows without those who opted out, written by date and counted from the files."""
    out = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    rows = table(spark, sf_dir, "events").where("value > 20").join(out, "user_id", "left_anti").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"))
    path = fresh_path(spark, "published")
    rows.repartition("date").write.partitionBy("date").json(path)
    read = spark.read.schema("event_id bigint, date string").json(path)
    return read.groupBy("date").agg(F.count("*").alias("rows"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new ' || c_name FROM customer WHERE c_custkey % 3 = 0")
def dml_02_conflict_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-02: rich rows are added; those whose key is there already are ignored."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return merge.insert_absent(c.where("id % 3 <> 0"), c.select("id", F.concat(F.lit("new "), "name").alias("name")), ["id"])


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'N' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 < 2 AND o_orderkey % 3 <> 0 THEN 1 ELSE o_totalprice END AS low, CASE WHEN o_orderkey % 4 < 2 AND o_orderkey % 3 <> 0 THEN NULL ELSE o_totalprice + 5 END AS high FROM orders""")
def dml_03_selective_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-03: one column is kept where the new value is null; two belong together and are taken over as a pair."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("low"), (F.col("o_totalprice") + 5).alias("high"))
    none = F.lit(None)
    new = o.where("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 0, "N").alias("status"), F.when(F.col("id") % 3 != 0, 1.0).alias("low"), none.cast("double").alias("high"))
    pair = F.col("n.low").isNotNull() | F.col("n.high").isNotNull()
    sets = {"status": F.coalesce("n.status", "t.status"), "low": F.when(pair, F.col("n.low")).otherwise(F.col("t.low")), "high": F.when(pair, F.col("n.high")).otherwise(F.col("t.high"))}
    return merge.update_where(o, new, ["id"], sets, F.lit(True))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 AND p_type IS NOT DISTINCT FROM CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type END THEN 'NEW' ELSE p_type END AS kind FROM part")
def dml_08_optimistic_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-08: a row changes only where it still has the value that the writer saw, null-safely."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"))
    new = part.where("id % 2 = 0").select("id", F.when(F.col("id") % 6 != 0, F.col("kind")).alias("seen"))
    return merge.update_where(part, new, ["id"], {"kind": F.lit("NEW")}, F.col("t.kind").eqNullSafe(F.col("n.seen")))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 0 THEN c_mktsegment || '+' ELSE c_mktsegment END AS industry, coalesce(CASE WHEN c_custkey % 2 = 0 AND c_custkey % 7 <> 0 THEN c_nationkey::INTEGER END, -1) AS size FROM customer")
def dml_11_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-11: enriched values fill in; nulls of the enrichment keep what is stored."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("industry"), F.lit(-1).alias("size"))
    found = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.concat("c_mktsegment", F.lit("+"))).alias("industry"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey").cast("int")).alias("size"))
    return merge.upsert(c, found, ["id"])


@query("SELECT currency, rate FROM (SELECT r_name AS currency, round(1.0 / (r_regionkey + 2), 12)::DOUBLE AS rate FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT r_name, (r_regionkey + 1)::DOUBLE FROM region WHERE r_regionkey % 2 = 1)")
def dml_12_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-12: new rates replace stored ones; currencies without a new rate keep theirs."""
    r = table(spark, sf_dir, "region")
    old = r.select(F.col("r_name").alias("currency"), (F.col("r_regionkey") + 1).cast("double").alias("rate"))
    new = r.where("r_regionkey % 2 = 0").select(F.col("r_name").alias("currency"), F.round(F.lit(1.0) / (F.col("r_regionkey") + 2), 12).alias("rate"))
    return merge.upsert(old, new, ["currency"])


# --- ingest states ---------------------------------------------------------------------


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 7 WHEN p_size % 2 = 0 THEN 1 ELSE 4 END AS threshold FROM part")
def str_04_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04: misses until a row ends: as configured, else 1 for rich sources and 4 for bare URLs."""
    configured = F.when(F.col("p_partkey") % 5 == 0, 7)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ingest.delist_threshold(F.col("p_size") % 2 == 0, configured).alias("threshold"))


_LOG = "(SELECT user_id AS board, event_id AS o, CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'signup' THEN 'success' END AS x FROM events WHERE event_type IN ('error', 'signup'))"
_LAST = f"(SELECT board, max(o) FILTER (x = 'success') AS ok FROM {_LOG} GROUP BY 1)"


@query(f"SELECT l.board, count(*) FILTER (x = 'failure' AND o > coalesce(ok, -1)) AS failures, count(*) FILTER (x = 'failure' AND o > coalesce(ok, -1)) >= 5 AS quarantined FROM {_LOG} l JOIN {_LAST} USING (board) GROUP BY 1")
def str_08_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-08: failures since the last success; five of them quarantine a board. Two aggregations, no log is gathered."""
    log = _log(spark, sf_dir)
    return ingest.failures_since_success(log, "board", "o", "x").select("board", "failures", (F.col("failures") >= ingest.FAILURES_QUARANTINE).alias("quarantined"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "signup", "success")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("board"), F.col("event_id").alias("o"), x.alias("x")).where("x IS NOT NULL")


@query(f"SELECT board, ok AS last_success, (SELECT count(*) FROM {_LOG} f WHERE f.board = l.board AND f.x = 'failure' AND f.o < ok) AS forgiven FROM {_LAST} l WHERE ok IS NOT NULL")
def str_09_success_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-09: the last success of each board and the failures that it wiped out."""
    log = _log(spark, sf_dir)
    last = log.where("x = 'success'").groupBy("board").agg(F.max("o").alias("last_success"))
    earlier = log.where("x = 'failure'").join(last, "board").where("o < last_success").groupBy("board").agg(F.count("*").alias("forgiven"))
    return last.join(earlier, "board", "left").fillna(0, ["forgiven"])


@query("""
WITH RECURSIVE log AS (
  SELECT board, t, x, row_number() OVER (PARTITION BY board ORDER BY t, x) AS i
  FROM (SELECT user_id AS board, epoch_us(ts) AS t, CASE WHEN event_type = 'signup' THEN 'success' ELSE 'gone' END AS x FROM events WHERE event_type <> 'view' AND ts IS NOT NULL)),
ends AS (SELECT board, max(i) AS last FROM log GROUP BY 1),
run AS (
  SELECT board, 0::BIGINT AS i, 'active' AS status, 0 AS n, NULL::BIGINT AS first_at, NULL::BIGINT AS last_at, NULL::BIGINT AS success_at, NULL::BIGINT AS gone_at, NULL::BIGINT AS next_at FROM ends
  UNION ALL
  SELECT board, i, CASE WHEN x = 'success' THEN 'active' WHEN over THEN 'gone' ELSE 'gone_pending' END, CASE WHEN x = 'success' THEN 0 ELSE n END, first_at, last_at, CASE WHEN x = 'success' THEN t ELSE success_at END,
    CASE WHEN x = 'success' OR NOT over THEN NULL ELSE coalesce(gone_at, t) END, CASE WHEN x <> 'success' THEN last_at + CASE WHEN over THEN 24 ELSE 6 END * 3600000000 END
  FROM (SELECT *, status = 'gone' OR n >= CASE WHEN t - success_at <= 168 * 3600000000 THEN 3 ELSE 2 END AS over
    FROM (SELECT board, i, t, x, status, success_at, gone_at, n + (counts AND status <> 'gone')::INTEGER AS n, CASE WHEN counts AND status <> 'gone' AND n = 0 THEN t ELSE first_at END AS first_at, CASE WHEN counts THEN t ELSE last_at END AS last_at
      FROM (SELECT r.board, l.i, l.t, l.x, r.status, r.n, r.first_at, r.last_at, r.success_at, r.gone_at,
          l.x = 'gone' AND CASE WHEN r.status = 'gone' THEN l.t - r.last_at >= 24 * 3600000000 ELSE r.n = 0 OR l.t - r.last_at >= 6 * 3600000000 END AS counts
        FROM run r JOIN log l ON l.board = r.board AND l.i = r.i + 1))))
SELECT run.board, status, n AS confirmations, first_at, last_at, success_at, gone_at, next_at FROM run JOIN ends ON run.board = ends.board AND run.i = ends.last""")
def str_10_gone_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10: "gone" answers six hours apart confirm; two end a board, three if it worked in the last seven days; ended boards are probed daily."""
    x = F.when(F.col("event_type") == "signup", "success").when(F.col("event_type") != "view", "gone")
    boards = gone.confirmed(table(spark, sf_dir, "events").select(F.col("user_id").alias("board"), "ts", x.alias("x")), "board", "ts", "x")
    return boards.select("board", "status", "confirmations", *[F.unix_micros(t).alias(t) for t in gone.TIMES])


@query("SELECT id, updated_at FROM (SELECT event_id AS id, ts AS updated_at FROM events) WHERE updated_at > TIMESTAMP '2024-01-10' AND updated_at < TIMESTAMP '2024-01-25' ORDER BY updated_at, id LIMIT 50".replace("SELECT id, updated_at FROM", "SELECT id, strftime(updated_at, '%Y-%m-%d') AS day FROM", 1))
def str_17_one_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-17: one target's batch of changes behind its own cursor (top-k is the batch size)."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("updated_at"))
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return publish.cdc_slice(rows, day("2024-01-10"), F.lit(10**12), day("2024-01-25"), 50).select("id", F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


@query(f"SELECT id FROM {POSTINGS} WHERE NOT is_active AND salary > 400000 AND id % 9 <> 0")
def str_22_repair_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-22: rows to repair from one reading of the table; a row that changed meanwhile is left alone."""
    p = postings(spark, sf_dir)
    found = p.where("NOT is_active AND salary > 400000").select("id", "is_active")
    now = p.select("id", F.when(F.col("id") % 9 == 0, ~F.col("is_active")).otherwise(F.col("is_active")).alias("now"))
    return found.join(now, "id").where(F.col("is_active") == F.col("now")).select("id")


# --- dataset ---------------------------------------------------------------------------


@query("SELECT count(*) AS rows, least(50000, greatest(10000, 250 * 60)) AS window_size, min(o_orderkey) AS first_id FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 15000)")
def smp_03_candidate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP-03: a sample of n draws from the newest min(50,000, max(10,000, 250 n)) rows (the window is the feature)."""
    size = dataset.window_size(60)
    newest = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(size)
    return newest.agg(F.count("*").alias("rows"), F.lit(size).alias("window_size"), F.min("o_orderkey").alias("first_id"))


@query("SELECT p_type AS id, least(4.0, sqrt(max(count(*)) OVER () / count(*))) AS weight FROM part GROUP BY 1")
def fn_64_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-64: rare strata weigh more, up to four times."""
    n = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("id")).agg(F.count("*").alias("n"))
    most = n.agg(F.max("n").alias("most"))
    return n.crossJoin(F.broadcast(most)).select("id", dataset.rarity(F.col("n"), F.col("most")).alias("weight"))


@query("""
WITH a AS (SELECT l_orderkey AS id, l_linenumber AS n, l_quantity AS s, l_quantity + l_tax * 100 AS e FROM lineitem), m AS (SELECT id, n, CASE WHEN n % 3 = 0 THEN s + 1 WHEN n % 3 = 1 THEN s + 9 ELSE s END AS s2, e AS e2 FROM a)
SELECT id, count(*) AS merged, count(*) FILTER (abs(s - s2) <= 2) AS agreed FROM a JOIN m USING (id, n) GROUP BY 1""".replace("JOIN m USING (id, n)", "JOIN m ON a.id = m.id AND a.n = m.n AND a.s = CASE WHEN m.n % 3 = 0 THEN m.s2 - 1 WHEN m.n % 3 = 1 THEN m.s2 - 9 ELSE m.s2 END AND a.e = m.e2").replace("SELECT id, count", "SELECT a.id, count"))
def qa_04_merge_with_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-04: two labellers' records of the same thing agree where their numbers differ by at most two."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("s"), (F.col("l_quantity") + F.col("l_tax") * 100).alias("e"))
    moved = F.when(F.col("n") % 3 == 0, F.col("s") + 1).when(F.col("n") % 3 == 1, F.col("s") + 9).otherwise(F.col("s"))
    both = a.join(a.select("id", "n", "s", "e", moved.alias("other")), ["id", "n", "s", "e"])
    return both.groupBy("id").agg(F.count("*").alias("merged"), F.count_if(dataset.agrees(F.col("s"), F.col("other"), 2.0)).alias("agreed"))


@query("SELECT p_partkey AS id, p_size AS old_years, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN p_size + 1 ELSE p_size END AS new_years FROM part WHERE p_size IS DISTINCT FROM CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN p_size + 1 ELSE p_size END")
def qa_10_changed_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-10: rows whose reprocessed value differs, null-safely."""
    new = F.when(F.col("p_size") % 4 == 0, F.lit(None)).when(F.col("p_size") % 4 == 1, F.col("p_size") + 1).otherwise(F.col("p_size"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("old_years"), new.alias("new_years")).where(~F.col("old_years").eqNullSafe(F.col("new_years")))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN o IS NULL AND n IS NOT NULL THEN 'added' WHEN o IS NOT NULL AND n IS NULL THEN 'lost' WHEN o <> n THEN 'changed' ELSE 'same' END AS kind FROM (SELECT CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS o, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 'X' ELSE p_type END AS n FROM part)) GROUP BY 1")
def qa_12_occupation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-12: added, lost, changed and same occupations after reprocessing."""
    old, new = F.when(F.col("p_size") % 5 != 0, F.col("p_type")), F.when(F.col("p_size") % 7 == 0, F.lit(None)).when(F.col("p_size") % 3 == 0, "X").otherwise(F.col("p_type"))
    kind = F.when(old.isNull() & new.isNotNull(), "added").when(old.isNotNull() & new.isNull(), "lost").when(old != new, "changed").otherwise("same")
    return table(spark, sf_dir, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
