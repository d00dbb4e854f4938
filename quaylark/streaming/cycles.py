"""Structured Streaming forms of the crawl and publish planes; each equals its batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest import after_outcome as _step
from ..operators.ingest import diff


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once within the delay; state older than the watermark goes."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, window: str, delay: str, key: str) -> DataFrame:
    """Counts of a key by time window; late rows within the delay still count."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


STATE = "status string, failures int, empties int, gones int"


def board_states(events: DataFrame, key: str, order: str, outcome: str) -> DataFrame:
    """Board states kept over a stream (key long, status, failures, empties): the fold of the batch form with stored state."""

    def fold(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("active", 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        for x in rows[outcome]:
            now = _step(now, x)
        state.update(now)
        yield pd.DataFrame({key: [k[0]], "status": [now[0]], "failures": [now[1]], "empties": [now[2]]})

    return events.groupBy(key).applyInPandasWithState(fold, f"{key} long, status string, failures int, empties int", STATE, "update", GroupStateTimeout.NoTimeout)


def diff_batches(found: DataFrame, stored: Callable[[SparkSession], DataFrame], sink: str, checkpoint: str) -> DataStreamWriter:
    """Every micro-batch diffed against what is stored then; the actions of batch N are the folder ``sink/batch=N``.

    A batch that Spark replays overwrites its own folder, so no action counts twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        actions = diff(batch.select("url", "board_id"), stored(batch.sparkSession))
        actions.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return found.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def publish(changes: DataFrame, target: str, checkpoint: str) -> DataStreamWriter:
    """One target with its own checkpoint: a target that fails does not hold back another."""
    return changes.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
