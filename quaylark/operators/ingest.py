"""Crawl cycles: five-way diff, guards, soft deletes, and board state machines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the crawl rules.
DROP_SHARE, DROP_HISTORY, BLAST_SHARE = 0.30, 3, 0.50
DELIST_API, DELIST_URL_ONLY = 1, 4
EMPTY_SUSPECT, EMPTY_DELIST, FAILURES_QUARANTINE = 3, 6, 5


def diff(discovered: DataFrame, existing: DataFrame) -> DataFrame:
    """(url, board_id, action) for discovered rows (url, board_id) against stored ones (url, board_id, is_active).

    new: not stored. foreign: stored under another board and live; foreign_relisted: the
    same, not live. relisted: own and not live; touched: own and live. A URL that another
    board owns keeps its owner.
    """
    d = discovered.dropDuplicates(["url"]).alias("d")
    e = existing.select("url", F.col("board_id").alias("owner"), "is_active").alias("e")
    own = F.col("owner") == F.col("board_id")
    action = (
        F.when(F.col("owner").isNull(), "new")
        .when(own & F.col("is_active"), "touched")
        .when(own, "relisted")
        .when(F.col("is_active"), "foreign")
        .otherwise("foreign_relisted")
    )
    return d.join(e, "url", "left").select("url", "board_id", action.alias("action"), F.coalesce("owner", "board_id").alias("owner"))


def delist_threshold(rich: Column, configured: Column) -> Column:
    """Misses until a posting goes: what the board sets (0 included), else 1 with content and 4 without."""
    return F.coalesce(configured, F.when(rich, DELIST_API).otherwise(DELIST_URL_ONLY))


def soft_delete(existing: DataFrame, seen: DataFrame, threshold: Column) -> DataFrame:
    """Count a miss for live rows that were not seen; they end at the threshold. Seen rows start anew."""
    both = existing.join(seen.select("url").distinct().withColumn("_seen", F.lit(True)), "url", "left")
    hit = F.coalesce("_seen", F.lit(False))
    misses = F.when(hit, F.lit(0)).when(F.col("is_active"), F.col("missing_count") + 1).otherwise(F.col("missing_count"))
    live = F.when(hit, F.lit(True)).otherwise(F.col("is_active") & (misses < threshold))
    return both.select(*[c for c in existing.columns if c not in ("is_active", "missing_count")], live.alias("is_active"), misses.alias("missing_count"))


def rolling_median(counts: DataFrame, key: str, order: str, value: str, last: int = 5) -> DataFrame:
    """Median and number of the ``last`` values before each row of its key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-last, -1)
    past = F.array_sort(F.collect_list(value).over(w))
    n = F.size("_past")
    mid = F.when(n % 2 == 1, F.try_element_at("_past", (n / 2 + 0.5).cast("int")).cast("double")).otherwise((F.try_element_at("_past", F.greatest(n / 2, F.lit(1)).cast("int")) + F.try_element_at("_past", (n / 2 + 1).cast("int"))) / 2)
    out = counts.withColumn("_past", past)
    return out.select(*counts.columns, n.alias("history"), F.when(n > 0, mid).alias("median")).drop("_past")


def drop_guard(value: Column, median: Column, history: Column, share: float = DROP_SHARE) -> Column:
    """The cycle found strictly less than the median without ``share``, with enough history."""
    return F.coalesce((history >= DROP_HISTORY) & (value < median * (1 - share)), F.lit(False))


def blast_guard(gone: Column, live: Column, share: float = BLAST_SHARE) -> Column:
    """The cycle would end strictly more than ``share`` of the live rows."""
    return F.coalesce(gone > live * share, F.lit(False))


def fold(events: DataFrame, key: str, order: Column, outcome: str) -> DataFrame:
    """Board state after its events in order: (key, status, failures, empties).

    success: all counters 0, active. failure: one more, quarantined from 5 on. empty: one
    more, suspect from 3, gone from 6 on. gone: two in a row, with nothing between, end the
    board. Rows are sorted within partitions of the key and folded as they pass, so a task
    holds one batch and one state, however long the log of a board is.
    """
    rows = events.select(F.col(key).alias("k"), order.alias("o"), F.col(outcome).alias("x")).repartition("k").sortWithinPartitions("k", "o", "x")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type, now, state, done = None, None, START, []
        begun = False
        for b in batches:
            key_type = b.schema.field("k").type
            for k, x in zip(b.column("k").to_pylist(), b.column("x").to_pylist()):
                if begun and k != now:
                    done.append((now, *state[:3]))
                    state = START
                now, begun = k, True
                state = after_outcome(state, x)
            if done:
                yield _states(done, key_type)
                done = []
        if begun:
            yield _states([(now, *state[:3])], key_type)

    return rows.mapInArrow(run, f"k {kind}, status string, failures int, empties int").withColumnRenamed("k", key)


START = ("active", 0, 0, 0)


def after_outcome(state: tuple[str, int, int, int], outcome: str | None) -> tuple[str, int, int, int]:
    """(status, failures, empties, gones) after one more outcome."""
    status, failures, empties, gones = state
    failures = failures + 1 if outcome == "failure" else 0 if outcome == "success" else failures
    empties = empties + 1 if outcome == "empty" else 0 if outcome == "success" else empties
    gones = gones + 1 if outcome == "gone" else 0
    if status != "gone":
        if outcome == "success":
            status = "active"
        elif gones >= 2 or empties >= EMPTY_DELIST:
            status = "gone"
        elif gones == 1:
            status = "gone_pending"
        elif failures >= FAILURES_QUARANTINE:
            status = "quarantined"
        elif empties >= EMPTY_SUSPECT:
            status = "suspect"
    return status, failures, empties, gones


def _states(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    keys, status, failures, empties = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(status, pa.string()), pa.array(failures, pa.int32()), pa.array(empties, pa.int32())], ["k", "status", "failures", "empties"])


def circuit(events: DataFrame, key: str, order: Column, failed: Column, threshold: int = 3, open_for: int = 4) -> DataFrame:
    """Circuit breaker over a log: (key, state, opened): open after ``threshold`` failures in a row; after ``open_for`` calls that it refuses, one probe."""
    log = events.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), failed.alias("x")))), lambda r: r["x"]).alias("log"))
    zero = F.struct(F.lit("closed").alias("state"), F.lit(0).alias("run"), F.lit(0).alias("wait"), F.lit(0).alias("opened"))

    def step(s: Column, bad: Column) -> Column:
        refused = (s["state"] == "open") & (s["wait"] > 0)
        run = F.when(refused, s["run"]).when(bad, s["run"] + 1).otherwise(0)
        opens = ~refused & bad & ((s["state"] == "open") | (run >= threshold))
        state = F.when(refused | opens, "open").otherwise("closed")
        wait = F.when(refused, s["wait"] - 1).when(opens, open_for).otherwise(0)
        return F.struct(state.alias("state"), run.alias("run"), wait.alias("wait"), (s["opened"] + opens.cast("int")).alias("opened"))

    return log.select(key, F.aggregate("log", zero, step).alias("s")).select(key, "s.state", "s.opened")


def failures_since_success(log: DataFrame, key: str, order: str, outcome: str) -> DataFrame:
    """(key, failures) after the last success of each key: two aggregations and a join, so no log is gathered in one row."""
    last = log.where(F.col(outcome) == "success").groupBy(key).agg(F.max(order).alias("_ok"))
    since = F.col("_ok").isNull() | (F.col(order) > F.col("_ok"))
    return log.join(last, key, "left").groupBy(key).agg(F.count_if((F.col(outcome) == "failure") & since).alias("failures"))
