"""Publishing a stream of changes to several targets, each batch once a target.

A micro-batch that Spark replays (after a lost driver, say) has its old number and rows, so
all that it writes lies in a folder of that number and is overwritten. Under ``ledger``:

* ``changes/batch=N``: the rows of a batch, kept for targets that lack it;
* ``committed/target=T/batch=N``: one row once target T has batch N;
* ``pinned/target=T``: the batch at which T stopped, and why.

A target that fails is pinned at its batch and the others go on; with each later batch it
first gets what it missed, in order. ``resume`` does the same without a new batch. A target's
writer may be called again with a batch that it had written without being committed, so it
overwrites by number, as ``folder`` does; a batch without rows is committed like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: What a target does with the rows of a batch and its number.
Writer = Callable[[DataFrame, int], None]


def folder(path: str) -> Writer:
    """A target of Parquet files: ``path/batch=N``, overwritten when the batch comes again."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def _marks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows under ``path``; none where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, ledger: str) -> DataFrame:
    """(target, batch) of what each target has."""
    return _marks(spark, f"{ledger}/committed", "target string, batch long").select("target", "batch").distinct()


def pinned(spark: SparkSession, ledger: str) -> DataFrame:
    """(target, batch, reason) of targets that stopped and have not gone on since."""
    last = committed(spark, ledger).withColumnRenamed("batch", "done")
    pins = _marks(spark, f"{ledger}/pinned", "target string, at long, reason string")
    still = pins.alias("p").join(last.alias("c"), F.expr("p.target = c.target AND p.at = c.done"), "left_anti")
    return still.select("target", F.col("at").alias("batch"), "reason")


def published(spark: SparkSession, ledger: str, target: str, path: str, schema: str) -> DataFrame:
    """Rows of a ``folder`` target, of committed batches only; the join prunes the folders of others."""
    own = committed(spark, ledger).where(F.col("target") == target).select("batch")
    return _marks(spark, path, f"{schema}, batch long").join(F.broadcast(own), "batch", "left_semi")  # a row a batch


def _catch_up(spark: SparkSession, ledger: str, targets: Mapping[str, Writer], upto: int, schema: str) -> None:
    """Give each target the batches up to ``upto`` that it lacks, in order, until one fails."""
    last = {r["target"]: r["batch"] for r in committed(spark, ledger).groupBy("target").agg(F.max("batch").alias("batch")).collect()}  # a row a target
    for name, write in targets.items():
        for number in range(last.get(name, -1) + 1, upto + 1):
            try:
                write(spark.read.schema(schema).parquet(f"{ledger}/changes/batch={number}"), number)
            except Exception as e:  # whatever a target raises stops this target only
                pin = spark.range(1).select(F.lit(number).cast("long").alias("at"), F.lit(f"{type(e).__name__}: {e}"[:500]).alias("reason"))
                pin.write.mode("overwrite").parquet(f"{ledger}/pinned/target={name}")
                break
            spark.range(1).write.mode("overwrite").parquet(f"{ledger}/committed/target={name}/batch={number}")


def publish_to(changes: DataFrame, targets: Mapping[str, Writer], ledger: str, checkpoint: str) -> DataStreamWriter:
    """A stream writer that gives every batch of ``changes`` to every target once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.schema)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{ledger}/changes/batch={number}")
        _catch_up(batch.sparkSession, ledger, targets, number, schema)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def resume(spark: SparkSession, targets: Mapping[str, Writer], ledger: str, schema: str) -> None:
    """Give pinned targets what they lack of the batches that were kept."""
    newest = _marks(spark, f"{ledger}/changes", f"{schema}, batch long").agg(F.max("batch").alias("batch")).first()["batch"]
    seen = committed(spark, ledger).agg(F.max("batch").alias("batch")).first()["batch"]  # an empty batch has no rows to see
    _catch_up(spark, ledger, targets, max((n for n in (newest, seen) if n is not None), default=-1), schema)
