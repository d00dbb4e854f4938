"""Folds of ordered logs whose outcomes compose, so that one board's log is the work of many tasks.

The rule of a board (``ingest.after_outcome``) has few statuses and counters that matter only
up to a limit, so it has finitely many states, and every outcome is a function from states to
states: an array. Stretches of a log compose by indexing one array with another, which is
associative. The log is range-partitioned by board and order; a task folds the boards that
lie within its range, and for the two that may go on in other ranges it puts out the
function of its stretch, with exact counters beside it. Those stretches, two a task at most,
then compose in order.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import EMPTY_DELIST, FAILURES_QUARANTINE, START, after_outcome

STATUSES = ("active", "gone_pending", "gone", "quarantined", "suspect")
_LIMITS = (FAILURES_QUARANTINE, EMPTY_DELIST, 2)
STATES = [(s, *c) for s in STATUSES for c in itertools.product(*(range(n + 1) for n in _LIMITS))]
_PLACE = {s: i for i, s in enumerate(STATES)}
_BEGIN = _PLACE[START]


def _capped(state: tuple[str, int, int, int]) -> int:
    return _PLACE[(state[0], *(min(c, n) for c, n in zip(state[1:], _LIMITS)))]


OUTCOMES = ("success", "failure", "empty", "gone", None)
#: What each outcome (any other counts as None) makes of each state.
STEPS = {o: np.array([_capped(after_outcome(s, o)) for s in STATES], np.int16) for o in OUTCOMES}


class Stretch:
    """A part of a log: its function on states, whether a success is in it, and failures and empties since (or in all)."""

    __slots__ = ("becomes", "reset", "failures", "empties")

    def __init__(self, becomes: np.ndarray | None = None, reset: bool = False, failures: int = 0, empties: int = 0):
        self.becomes = np.arange(len(STATES), dtype=np.int16) if becomes is None else becomes
        self.reset, self.failures, self.empties = reset, failures, empties

    def add(self, outcome: str | None) -> None:
        self.becomes = STEPS.get(outcome, STEPS[None])[self.becomes]
        if outcome == "success":
            self.reset, self.failures, self.empties = True, 0, 0
        self.failures += outcome == "failure"
        self.empties += outcome == "empty"

    def then(self, later: Stretch) -> Stretch:
        """The two stretches as one."""
        both = later.becomes[self.becomes]
        if later.reset:
            return Stretch(both, True, later.failures, later.empties)
        return Stretch(both, self.reset, self.failures + later.failures, self.empties + later.empties)

    def end(self) -> tuple[str, int, int]:
        """(status, failures, empties) of a board that begins here."""
        return STATES[self.becomes[_BEGIN]][0], self.failures, self.empties


def _rows(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    kinds = [key_type, pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.bool_(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["k", "part", "at", "status", "becomes", "reset", "failures", "empties"])


def stretches(events: DataFrame, key: str, order: Column, outcome: str, parts: int) -> DataFrame:
    """Boards within one of ``parts`` ranges with their status, and stretches of those that may lie in more (status null)."""
    rows = events.select(F.col(key).alias("k"), order.alias("o"), F.col(outcome).alias("x"))
    placed = rows.repartitionByRange(parts, "k", "o", "x").sortWithinPartitions("k", "o", "x")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, now, open_, key_type = TaskContext.get().partitionId(), 0, None, None, None
        for b in batches:
            key_type, done = b.schema.field("k").type, []
            for k, x in zip(b.column("k").to_pylist(), b.column("x").to_pylist()):
                if open_ is None or k != now:
                    if open_ is not None:
                        done.append(_stretch_row(now, part, at, open_, first=at == 0, last=False))
                        at += 1
                    now, open_ = k, Stretch()
                open_.add(x)
            if done:
                yield _rows(done, key_type)
        if open_ is not None:
            yield _rows([_stretch_row(now, part, at, open_, at == 0, True)], key_type)

    return placed.mapInArrow(run, f"k {kind}, part int, at int, status string, becomes binary, reset boolean, failures long, empties long")


def _stretch_row(k: object, part: int, at: int, s: Stretch, first: bool, last: bool) -> tuple:
    if first or last:
        return k, part, at, None, s.becomes.tobytes(), s.reset, s.failures, s.empties
    return k, part, at, s.end()[0], None, s.reset, s.failures, s.empties


def fold(events: DataFrame, key: str, order: Column, outcome: str, parts: int | None = None) -> DataFrame:
    """(key, status, failures, empties) of every board after its outcomes in order, as ``ingest.fold``.

    Rows alike in key, order and outcome lie in one range; a null key is a board of its own;
    unknown outcomes only break a run of "gone"; an empty log gives no rows.
    """
    found = stretches(events, key, order, outcome, parts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = found.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, whole, ended, key_type = False, None, Stretch(), None, None

        def row() -> tuple:
            return (now, *(ended or whole.end()))

        for b in batches:
            key_type, done = b.schema.field("k").type, []
            for r in b.to_pylist():
                if begun and r["k"] != now:
                    done.append(row())
                    whole, ended = Stretch(), None
                begun, now = True, r["k"]
                if r["status"] is not None:
                    ended = r["status"], r["failures"], r["empties"]
                else:
                    whole = whole.then(Stretch(np.frombuffer(r["becomes"], np.int16), r["reset"], r["failures"], r["empties"]))
            if done:
                yield _boards(done, key_type)
        if begun:
            yield _boards([row()], key_type)

    joined = found.repartition("k").sortWithinPartitions("k", "part", "at")
    return joined.mapInArrow(run, f"k {kind}, status string, failures long, empties long").withColumnRenamed("k", key)


def _boards(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [key_type, pa.string(), pa.int64(), pa.int64()])], ["k", "status", "failures", "empties"])
