"""Ordered folds against plain loops; streams against their batch forms."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quaylark.operators import ingest, merge, publish
from quaylark.plans.cycles import _board_log
from quaylark.streaming import cycles
from quaylark.tables import table


def states(log):
    out = {}
    for key, outcomes in log.items():
        status, failures, empties, gones = "active", 0, 0, 0
        for x in outcomes:
            status, failures, empties, gones = cycles._step((status, failures, empties, gones), x)
        out[key] = (status, failures, empties)
    return out


def test_board_states_follow_a_plain_loop(spark, sf_dir):
    rows = _board_log(spark, sf_dir).collect()
    log = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["event_id"]):
        log[r["user_id"]].append(r["outcome"])
    got = {r[0]: tuple(r)[1:] for r in ingest.fold(_board_log(spark, sf_dir), "user_id", F.col("event_id"), "outcome").collect()}
    assert got == states(log)


@pytest.mark.parametrize("outcomes,status", [("f" * 5, "quarantined"), ("e" * 3, "suspect"), ("e" * 6, "gone"), ("g", "gone_pending"), ("gg", "gone"), ("gsg", "gone_pending"), ("ffffsf", "active"), ("", None)])
def test_board_states(spark, outcomes, status):
    names = {"f": "failure", "e": "empty", "g": "gone", "s": "success"}
    df = spark.createDataFrame([(1, i, names[o]) for i, o in enumerate(outcomes)], "k long, i long, o string")
    got = ingest.fold(df, "k", F.col("i"), "o").collect()
    assert (got[0]["status"] if got else None) == status


def test_circuit_opens_refuses_and_probes(spark):
    def run(bits):
        df = spark.createDataFrame([(1, i, b == "1") for i, b in enumerate(bits)], "k int, i int, bad boolean")
        r = ingest.circuit(df, "k", F.col("i"), F.col("bad"), threshold=2, open_for=2).first()
        return r["state"], r["opened"]

    assert run("10101") == ("closed", 0)
    assert run("11") == ("open", 1)
    assert run("1100") == ("open", 1)  # two calls refused
    assert run("11000") == ("closed", 1)  # the probe succeeds
    assert run("11001") == ("open", 2)  # the probe fails


def test_diff_actions(spark):
    stored = spark.createDataFrame([("a", 1, True), ("b", 1, False), ("c", 2, True), ("d", 2, False)], "url string, board_id int, is_active boolean")
    found = spark.createDataFrame([(u, 1) for u in "abcdee"], "url string, board_id int")
    got = {r["url"]: (r["action"], r["owner"]) for r in ingest.diff(found, stored).collect()}
    assert got == {"a": ("touched", 1), "b": ("relisted", 1), "c": ("foreign", 2), "d": ("foreign_relisted", 2), "e": ("new", 1)}


def test_guards_are_strict(spark):
    v = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert not v(ingest.drop_guard(F.lit(70), F.lit(100.0), F.lit(5)))
    assert v(ingest.drop_guard(F.lit(69), F.lit(100.0), F.lit(5)))
    assert not v(ingest.drop_guard(F.lit(0), F.lit(100.0), F.lit(2)))
    assert not v(ingest.blast_guard(F.lit(5), F.lit(10)))
    assert v(ingest.blast_guard(F.lit(6), F.lit(10)))
    assert v(ingest.delist_threshold(F.lit(True), F.lit(0))) == 0


def test_slices_skip_and_repeat_nothing(spark):
    rows = spark.createDataFrame([(i, i // 3) for i in range(20)], "id long, updated_at long")
    at, seen = (-1, -1), []
    while True:
        part = publish.cdc_slice(rows, F.lit(at[0]), F.lit(at[1]), F.lit(5), 4).collect()
        if not part:
            break
        seen += [r["id"] for r in part]
        at = (part[-1]["updated_at"], part[-1]["id"])
    assert seen == list(range(15))  # rows from the cutoff on wait


def test_upsert_and_rejects(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    n = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, merge.upsert(t, n, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, merge.upsert(t, n, ["k"], coalesce=False).collect()), key=str) == [(1, "a"), (2, None), (3, "c")]
    good, bad = merge.split_rejects(n, {"v": F.col("v").isNotNull()})
    assert good.count() == 1 and bad.first()["failed"] == ["v"]


@pytest.fixture()
def event_files(spark, sf_dir, tmp_path):
    log = _board_log(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 60))
    n = log.count()
    for i in range(3):
        log.where((F.col("event_id") >= i * n / 3) & (F.col("event_id") < (i + 1) * n / 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), log.schema.simpleString()[7:-1].replace(":", " ")


def run(writer, name):
    q = writer.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_streamed_states_equal_batch(spark, sf_dir, event_files, tmp_path):
    stream = cycles.read_events(spark, *event_files)
    out = cycles.board_states(stream, "user_id", "event_id", "outcome")
    sink = str(tmp_path / "out")
    q = out.writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("b", F.lit(i)).write.mode("append").parquet(sink))
    q = q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    last = spark.read.parquet(sink).groupBy("user_id").agg(F.max_by(F.struct("status", "failures", "empties"), "b").alias("s")).collect()
    want = {r[0]: tuple(r)[1:] for r in ingest.fold(_board_log(spark, sf_dir), "user_id", F.col("event_id"), "outcome").collect()}
    assert {r["user_id"]: tuple(r["s"]) for r in last} == want


def test_streamed_dedupe_and_windows(spark, event_files, tmp_path):
    stream = cycles.read_events(spark, *event_files)
    run(cycles.deduplicated(stream, "event_id", "ts", "1 day").writeStream.option("checkpointLocation", str(tmp_path / "d")), "deduped")
    batch = spark.read.parquet(event_files[0])
    assert spark.table("deduped").count() == batch.select("event_id").distinct().count()
    run(cycles.windowed_counts(stream, "ts", "1 hour", "10 minutes", "outcome").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "w")), "windowed")
    total = spark.table("windowed").groupBy("start", "outcome").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0]
    assert total == batch.count()


def test_streamed_diff_and_publish(spark, sf_dir, tmp_path):
    pages = table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 3).alias("board_id"))
    pages.write.parquet(str(tmp_path / "found"))
    stored = pages.limit(10).withColumn("is_active", F.lit(True))
    stored.write.parquet(str(tmp_path / "stored"))
    stream = cycles.read_events(spark, str(tmp_path / "found"), "url string, board_id long")
    q = cycles.diff_batches(stream, lambda s: s.read.parquet(str(tmp_path / "stored")), str(tmp_path / "actions"), str(tmp_path / "ca")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    n = {r["action"]: r["count"] for r in spark.read.parquet(str(tmp_path / "actions")).groupBy("action").count().collect()}
    assert n["touched"] == stored.select("url").distinct().count()
    q = cycles.publish(stream, str(tmp_path / "target"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "target")).count() == pages.count()
