"""Confirmation of boards whose provider says that they are gone.

One "gone" answer proves little, so a board ends only after two confirmations, three if it
worked in the ``RECENT`` time before the answer. An answer confirms if the last confirmation
is ``SPACING`` or more ago, so confirmations are chosen greedily along the log. A board that
ended is probed once in ``RECOVERY``; a success starts it anew and keeps the times of the
last episode. Other outcomes change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000_000
#: Fixed values, in microseconds.
SPACING, RECENT, RECOVERY = 6 * HOUR, 7 * 24 * HOUR, 24 * HOUR
FEW, MANY = 2, 3


class Gone(NamedTuple):
    """What is known of a board; times are microseconds, or None."""

    status: str = "active"
    confirmations: int = 0
    first_at: int | None = None
    last_at: int | None = None
    success_at: int | None = None
    gone_at: int | None = None
    next_at: int | None = None


TIMES = ("first_at", "last_at", "success_at", "gone_at", "next_at")
COLUMNS = "status string, confirmations int, " + ", ".join(f"{t} timestamp" for t in TIMES)


def after_answer(board: Gone, outcome: str | None, at: int) -> Gone:
    """The board after one more answer at ``at``; answers come in order of time."""
    if outcome == "success":
        return board._replace(status="active", confirmations=0, success_at=at, gone_at=None, next_at=None)
    if outcome != "gone":
        return board
    if board.status == "gone":
        last = at if at - board.last_at >= RECOVERY else board.last_at
        return board._replace(last_at=last, next_at=last + RECOVERY)
    if board.confirmations == 0:
        board = board._replace(confirmations=1, first_at=at, last_at=at)
    elif at - board.last_at >= SPACING:
        board = board._replace(confirmations=board.confirmations + 1, last_at=at)
    worked = board.success_at is not None and at - board.success_at <= RECENT
    if board.confirmations >= (MANY if worked else FEW):
        return board._replace(status="gone", gone_at=at, next_at=board.last_at + RECOVERY)
    return board._replace(status="gone_pending", gone_at=None, next_at=board.last_at + SPACING)


def confirmed(log: DataFrame, key: str, time: str, outcome: str) -> DataFrame:
    """(key, status, confirmations, first_at, last_at, success_at, gone_at, next_at) of every board after its log.

    The log is sorted within partitions of the key and passes a task as a stream, with one
    board in hand: memory does not grow with a board's log, though the greedy choice makes one
    board the work of one task. Outcomes that change nothing go before the shuffle. Answers at
    one time go by outcome, repeated ones change nothing; rows without a time are left out; a
    null key is a board of its own; an empty log gives no rows.
    """
    rows = log.select(F.col(key).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(outcome).alias("x"))
    rows = rows.where(F.col("x").isin("success", "gone") & F.col("t").isNotNull()).repartition("k").sortWithinPartitions("k", "t", "x")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, board = False, None, Gone()
        for b in batches:
            done = []
            for k, t, x in zip(*(b.column(c).to_pylist() for c in ("k", "t", "x"))):
                if begun and k != now:
                    done.append((now, *board))
                    board = Gone()
                begun, now, board = True, k, after_answer(board, x, t)
            if done:
                yield _boards(done, b.schema.field("k").type)
            key_type = b.schema.field("k").type
        if begun:
            yield _boards([(now, *board)], key_type)

    return rows.mapInArrow(run, f"k {kind}, {COLUMNS}").withColumnRenamed("k", key)


def _boards(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    keys, status, confirmations, *times = zip(*rows)
    columns = [pa.array(keys, key_type), pa.array(status, pa.string()), pa.array(confirmations, pa.int32()), *(pa.array(t, pa.timestamp("us", "UTC")) for t in times)]
    return pa.RecordBatch.from_arrays(columns, ["k", "status", "confirmations", *TIMES])
