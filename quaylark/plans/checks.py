"""Strict reads, schema checks, readiness, and whole crawl cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ingest, merge
from ..registry import query
from ..sources import readers
from ..storage import fresh_path
from ..tables import POSTINGS, postings, table
from .relations import snapshot_diff


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation")
def src_05_strict_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05: an inventory written as CSV and read back with its header, keys and count checked."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    path = fresh_path(spark, "inventory")
    n.coalesce(1).write.csv(path, header=True)
    return readers.read_strict_csv(spark, path, ["id", "name"], "id", n.count())


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def src_06_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06: JSON lines, any malformed line ends the read."""
    path = fresh_path(spark, "jsonl")
    table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).write.json(path)
    return readers.read_jsonl(spark, path, "id int, name string")


@query("SELECT doc_id, source, length(text) AS n FROM documents")
def src_07_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07: a framed export: one JSON object a line, lines end with LF only."""
    path = fresh_path(spark, "frames")
    docs = table(spark, sf_dir, "documents")
    docs.select(F.to_json(F.struct("doc_id", "source", "text")).alias("value")).write.text(path, lineSep="\n")
    return readers.read_frames(spark, path, "doc_id long, source string, text string").select("doc_id", "source", F.length("text").cast("long").alias("n"))


@query("SELECT p_partkey AS id, p_name AS name FROM part")
def src_31_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-31: reference data imported over a partial copy."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    partial = rows.where("id % 3 = 0").withColumn("name", F.lit("old"))
    return merge.upsert(partial, rows, ["id"])


@query("SELECT count(*) FILTER (k BETWEEN 0 AND 79) AS valid, count(*) FILTER (k > 79) AS out_of_range, count(*) FILTER (k IS NULL) AS malformed FROM (SELECT CASE WHEN event_id % 50 = 0 THEN NULL ELSE (props ->> '$.k')::BIGINT END AS k FROM events)")
def qa_03_schema_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-03: JSON against a schema and a range; malformed records are counted, not dropped."""
    raw = F.when(F.col("event_id") % 50 == 0, F.lit('{"k": tru')).otherwise(F.col("props"))
    k = F.from_json(raw, "k long, _bad string", {"columnNameOfCorruptRecord": "_bad"})["k"]
    return table(spark, sf_dir, "events").select(k.alias("k")).agg(F.count_if(F.col("k").between(0, 79)).alias("valid"), F.count_if(F.col("k") > 79).alias("out_of_range"), F.count_if(F.col("k").isNull()).alias("malformed"))


@query("""
WITH e AS (SELECT n_nationkey AS id, sha256(n_name) AS f FROM nation), r AS (SELECT n_nationkey AS id, sha256(CASE WHEN n_nationkey = 3 THEN 'x' ELSE n_name END) AS f FROM nation WHERE n_nationkey <> 7)
SELECT count(*) FILTER (r.id IS NULL) AS missing, count(*) FILTER (e.f <> r.f) AS changed, count(*) FILTER (r.id IS NULL OR e.f <> r.f) = 0 AS ready FROM e LEFT JOIN r USING (id)""")
def qa_08_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-08: expected taxonomy documents against the remote ones."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit(True).alias("is_active"), "n_name")
    local = n.select("id", "is_active", F.sha2("n_name", 256).alias("fingerprint"))
    remote = n.where("id <> 7").select("id", "is_active", F.sha2(F.when(F.col("id") == 3, "x").otherwise(F.col("n_name")), 256).alias("fingerprint"))
    d = snapshot_diff(local, remote)
    missing, changed = F.count_if(F.col("kind") == "missing"), F.count_if(F.col("kind") == "payload")
    return d.agg(missing.alias("missing"), changed.alias("changed"), (missing + changed == 0).alias("ready"))


@query("""
WITH w AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS mark, max(ts) AS last FROM events GROUP BY 1)
SELECT user_id, epoch_us(mark) AS mark_us, last > mark + INTERVAL 7 DAY OR mark IS NULL AS full_crawl FROM w""")
def str_11_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11: the high-water mark of each board, and whether its full crawl is due."""
    mark = F.max(F.when(F.col("event_type") == "view", F.col("ts")))
    w = table(spark, sf_dir, "events").groupBy("user_id").agg(mark.alias("mark"), F.max("ts").alias("last"))
    due = (F.col("last") > F.col("mark") + F.expr("INTERVAL 7 DAYS")) | F.col("mark").isNull()
    return w.select("user_id", F.unix_micros(F.col("mark").cast("timestamp")).alias("mark_us"), due.alias("full_crawl"))


@query(f"""
WITH gate AS (SELECT coalesce(min(o_orderdate), TIMESTAMP '2100-01-01') AS cutoff FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 499000)
SELECT count(*) AS n FROM {POSTINGS}, gate WHERE first_seen < cutoff""")
def joi_12_cutoff_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-12: one row with the oldest open writer's start gates all rows; no writer, no gate."""
    p = postings(spark, sf_dir)
    writers = p.where("status = 'P' AND salary > 499000").agg(F.coalesce(F.min("first_seen"), F.lit("2100-01-01").cast("timestamp_ntz")).alias("cutoff"))
    return p.crossJoin(F.broadcast(writers)).where("first_seen < cutoff").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT user_id AS board, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'error') > 3 AS truncated FROM events GROUP BY 1, 2),
w AS (SELECT *, median(n) OVER p AS m, count(*) OVER p AS h FROM c WINDOW p AS (PARTITION BY board ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT board, day, CASE WHEN truncated THEN 'recorded' WHEN coalesce(h >= 3 AND n < m * 0.7, FALSE) THEN 'skipped' ELSE 'applied' END AS outcome FROM w""")
def str_01_board_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01/06: the outcome of every cycle of every board: truncated ones delete nothing, dropped ones are skipped."""
    e = table(spark, sf_dir, "events")
    c = e.groupBy(F.col("user_id").alias("board"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), (F.count_if(F.col("event_type") == "error") > 3).alias("truncated"))
    w = ingest.rolling_median(c, "board", "day", "n")
    dropped = ingest.drop_guard(F.col("n"), F.col("median"), F.col("history"))
    return w.select("board", "day", F.when(F.col("truncated"), "recorded").when(dropped, "skipped").otherwise("applied").alias("outcome"))


@query(f"SELECT seniority, id, salary FROM (SELECT *, row_number() OVER (PARTITION BY seniority ORDER BY salary DESC, id) AS r FROM {POSTINGS} WHERE is_active) WHERE r = 2")
def win_02_second_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02: the second of each group in its own order."""
    w = Window.partitionBy("seniority").orderBy(F.desc("salary"), "id")
    return postings(spark, sf_dir).where("is_active").withColumn("r", F.row_number().over(w)).where("r = 2").select("seniority", "id", "salary")
