"""Gone confirmations and composed folds against plain loops, streams against batch."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quaylark.operators import composed, gone, ingest
from quaylark.streaming import gone as streamed
from quaylark.streaming.cycles import read_events

H, DAY = datetime.timedelta(hours=1), datetime.timedelta(days=1)
T0 = datetime.datetime(2024, 1, 1)
LOG = "k string, t timestamp, x string"


def at(hours: float) -> datetime.datetime:
    return T0 + hours * H


def plain(log):
    """The rule as one loop over a board's sorted answers, in datetimes."""
    out = {}
    for key, answers in log.items():
        status, n, first, last, ok, ended, due = "active", 0, None, None, None, None, None
        for t, x in sorted(answers):
            if x == "success":
                status, n, ok, ended, due = "active", 0, t, None, None
            elif status == "gone":
                if t >= last + DAY:
                    last = t
                due = last + DAY
            else:
                if n == 0 or t >= last + 6 * H:
                    first, last, n = (t if n == 0 else first), t, n + 1
                if n >= (3 if ok is not None and ok >= t - 7 * DAY else 2):
                    status, ended, due = "gone", t, last + DAY
                else:
                    status, due = "gone_pending", last + 6 * H
        out[key] = (status, n, first, last, ok, ended, due)
    return out


def found(df):
    return {r["k"]: tuple(r)[1:] for r in df.collect()}


def test_confirmations_are_spaced_from_the_last(spark):
    day = 24
    rows = [("a", 0, "success"), ("a", day, "gone"), ("a", day + 11.98, "gone"), ("a", day + 12.02, "gone")]  # the second is the last that counts
    rows += [("b", 0, "gone"), ("b", 5.9, "gone")] + [("c", 0, "gone"), ("c", 6, "gone")]
    rows += [("d", 0, "success"), ("d", 100, "gone"), ("d", 106, "gone"), ("d", 169, "gone")]  # the success is old by then: two are enough
    rows += [("e", 0, "gone"), ("e", 6, "gone"), ("e", 12, "gone"), ("e", 31, "gone")]  # probes of an ended board
    rows += [("f", 0, "gone"), ("f", 6, "gone"), ("f", 7, "success"), ("f", 8, "gone")]  # a new episode
    got = found(gone.confirmed(spark.createDataFrame([(k, at(t), x) for k, t, x in rows], LOG), "k", "t", "x"))
    short = {k: v[:2] for k, v in got.items()}
    assert short == {"a": ("gone_pending", 2), "b": ("gone_pending", 1), "c": ("gone", 2), "d": ("gone", 3), "e": ("gone", 2), "f": ("gone_pending", 1)}
    assert got["e"][3] == at(31) and got["e"][6] == at(55) and got["e"][5] == at(6)
    assert got["f"][2] == at(8) and got["f"][4] == at(7) and got["f"][5] is None


@pytest.fixture(scope="module")
def random_log():
    rng = random.Random(9)
    rows = []
    for k in range(60):
        t = 0.0
        for _ in range(rng.randint(0, 40)):
            t += rng.choice([0, 0.5, 3, 6, 6.5, 24, 100])
            rows.append((str(k), at(t), rng.choice(["gone", "gone", "gone", "success", "failure", None])))
    return rows


def test_random_logs(spark, random_log):
    log = defaultdict(list)
    for k, t, x in random_log:
        if x in ("gone", "success"):
            log[k].append((t, x))
    df = spark.createDataFrame(random_log * 2 + [("z", None, "gone")], LOG).repartition(5)
    assert found(gone.confirmed(df, "k", "t", "x")) == plain(log)
    assert gone.confirmed(df.limit(0), "k", "t", "x").count() == 0


def test_stream_equals_batch(spark, random_log, tmp_path):
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = sorted((r for r in random_log), key=lambda r: r[1])
        for i in range(3):
            part = rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3]
            spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streamed.confirmations(read_events(spark, str(tmp_path / "in"), LOG), "k", "t", "x", "1000 days")
        q = stream.writeStream.outputMode("append").foreachBatch(lambda df, i: df.withColumn("b", F.lit(i)).write.mode("append").parquet(str(tmp_path / "out")))
        q = q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(150) and q.exception() is None
        columns = ["status", "confirmations", *gone.TIMES]
        last = spark.read.parquet(str(tmp_path / "out")).where("kind = 'state'").groupBy("k").agg(F.max_by(F.struct(*columns), "b").alias("s")).select("k", "s.*")
        assert found(last) == found(gone.confirmed(spark.createDataFrame(rows, LOG), "k", "t", "x"))
    finally:
        spark.conf.set(store, before)


def test_probes_fall_due(spark, tmp_path):
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # a second board's answers move the watermark past the first one's next check
        for i, part in enumerate([[("a", at(0), "gone"), ("a", at(6), "gone")], [("b", at(200), "gone")], [("b", at(201), "gone")]]):
            spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streamed.confirmations(read_events(spark, str(tmp_path / "in"), LOG), "k", "t", "x", "0 seconds")
        q = stream.writeStream.outputMode("append").format("memory").queryName("probes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(150) and q.exception() is None
        due = spark.table("probes").where("kind = 'probe' AND k = 'a'").collect()
        assert [(r["status"], r["confirmations"], r["next_at"]) for r in due] == [("gone", 2, at(30))]
    finally:
        spark.conf.set(store, before)


def test_outcomes_compose():
    rng = random.Random(2)
    for _ in range(200):
        log = [rng.choice(["success", "failure", "empty", "gone", "failure", "odd", None]) for _ in range(rng.randint(0, 30))]
        state = ingest.START
        for x in log:
            state = ingest.after_outcome(state, x)
        cut = sorted(rng.randint(0, len(log)) for _ in range(3))
        parts = []
        for a, b in zip([0, *cut], [*cut, len(log)]):
            parts.append(composed.Stretch())
            for x in log[a:b]:
                parts[-1].add(x)
        left = parts[0].then(parts[1]).then(parts[2]).then(parts[3])
        right = parts[0].then(parts[1].then(parts[2].then(parts[3])))
        assert left.end() == right.end() == state[:3]


@pytest.mark.parametrize("boards", [1, 3, 40])
def test_composed_fold_equals_the_loop(spark, boards):
    rng = random.Random(boards)
    rows = [(rng.randrange(boards) if rng.random() < 0.3 else 0, i, rng.choice(["success"] + ["failure", "empty", "gone", None] * 4)) for i in range(3000)] + [(None, 1, "gone"), (None, 2, "gone")]
    df = spark.createDataFrame(rows, "k long, i long, o string").repartition(6)
    log = defaultdict(list)
    for k, _, o in sorted(rows, key=lambda r: r[1]):
        log[k].append(o)
    want = {}
    for k, outcomes in log.items():
        state = ingest.START
        for o in outcomes:
            state = ingest.after_outcome(state, o)
        want[k] = state[:3]
    assert found(composed.fold(df, "k", F.col("i"), "o", parts=8)) == want
    parts = composed.stretches(df, "k", F.col("i"), "o", 8).where("k = 0").select("part").distinct().count()
    assert parts >= (8 if boards == 1 else 4)  # the hot board is the work of many tasks
    assert composed.fold(df.limit(0), "k", F.col("i"), "o").count() == 0
