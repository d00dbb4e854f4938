"""Gone confirmations over a stream, with stored state and timers; the last row of a board equals the batch form."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.gone import HOUR, Gone, after_answer

#: A board without answers for this long is forgotten.
KEEP = 60 * 24 * HOUR
_STATE = "status string, confirmations int, first_at long, last_at long, success_at long, gone_at long, next_at long, seen_at long"
#: Rows that the processor puts out: a board after its answers of a batch, and probes when they fall due.
OUT = "kind string, status string, confirmations int, first_at timestamp, last_at timestamp, success_at timestamp, gone_at timestamp, next_at timestamp"


def _time(micros: int | None) -> pd.Timestamp | None:
    return None if micros is None else pd.Timestamp(int(micros), unit="us")


class Confirmations(StatefulProcessor):
    """Keeps a board's state; a timer at its next check says that a probe is due, one after ``KEEP`` forgets it."""

    def __init__(self, key: str, time: str, outcome: str):
        self.key, self.time, self.outcome = key, time, outcome

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("board", _STATE)

    def _load(self) -> tuple[Gone, int | None]:
        if not self.state.exists():
            return Gone(), None
        kept = [None if v is None or v != v else v for v in self.state.get()]
        return Gone(kept[0], int(kept[1]), *(None if v is None else int(v) for v in kept[2:7])), int(kept[7])

    def _row(self, key: Any, kind: str, board: Gone) -> pd.DataFrame:
        times = [pd.Series([_time(t)], dtype="datetime64[us]") for t in board[2:]]
        return pd.DataFrame(dict(zip([self.key, "kind", "status", "confirmations", "first_at", "last_at", "success_at", "gone_at", "next_at"], [[key], [kind], [board.status], [board.confirmations], *times])))

    def _arm(self, before: int | None, after: int | None) -> None:
        if before is not None:
            self.handle.deleteTimer(before // 1000)
        if after is not None:
            self.handle.registerTimer(after // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        board, seen = self._load()
        old_next, old_seen = board.next_at, seen
        log = pd.concat(list(rows)).dropna(subset=[self.time])
        if log.empty:
            return
        log = log.sort_values([self.time, self.outcome], na_position="first").drop_duplicates([self.time, self.outcome])
        for at, outcome in zip(log[self.time], log[self.outcome]):
            micros = at.value // 1000
            board, seen = after_answer(board, outcome, micros), max(seen or micros, micros)
        self.state.update((*board, seen))
        self._arm(old_next, board.next_at)
        self._arm(old_seen + KEEP if old_seen is not None else None, seen + KEEP)
        yield self._row(key[0], "state", board)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        board, seen = self._load()
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if seen is not None and at >= (seen + KEEP) // 1000 * 1000:
            self.state.clear()
        elif board.next_at is not None:
            yield self._row(key[0], "probe", board)

    def close(self) -> None:
        pass


def confirmations(answers: DataFrame, key: str, time: str, outcome: str, delay: str = "1 hour") -> DataFrame:
    """A stream of answers to rows of ``OUT``; answers later than the delay behind the watermark are too late.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    kind = answers.schema[key].dataType.simpleString()
    rows = answers.select(key, time, outcome).where(answers[outcome].isin("success", "gone")).withWatermark(time, delay)
    return rows.groupBy(key).transformWithStateInPandas(Confirmations(key, time, outcome), f"{key} {kind}, {OUT}", "Append", "EventTime")
