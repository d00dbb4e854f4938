"""Table reading and Arrow helpers for the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import fresh_path, shared_dir, stored  # noqa: F401


#: Rows of an Arrow batch, where the session has Spark's default: whole texts are wide, and a batch lies in memory on both sides.
BATCH_ROWS = 1000
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows; a session that asks for another number keeps it."""
    if spark.conf.get(_BATCH_CONF) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, BATCH_ROWS)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null becomes the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that very long texts bound memory less."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def wider(batches: Iterable[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The same narrow rows in batches of ``rows`` or more, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def by_size(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            begun = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, begun + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def ragged_take(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[s:s+n]`` for each pair of starts and sizes."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column of ``df`` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_hash(text_col: str = "text") -> Column:
    """64-bit hash that names a text; null and the empty text are alike."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def one_row_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of ``groups`` (node, root), where node is ``text_hash``.

    The row with the least doc_id stays, rows without one come last; texts that are not in
    ``groups`` are groups of their own. Of rows alike in text and doc_id (or without one)
    the least by all columns stays, maps compared as JSON.
    """
    node = free_name(docs, "_node")
    named = docs.withColumn(node, text_hash())
    alike = named.groupBy(F.col(node).alias("node"), "doc_id").agg(F.count("*").alias("n"))
    least = alike.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("node"), F.col("n"))).alias("least"))
    rooted = least.join(groups.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = stored(rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.node", "least.doc_id", "least.n"), "kept")

    def rows_of(wanted: DataFrame) -> DataFrame:
        own, other = named.alias("own"), wanted.alias("other")
        return own.join(other, (F.col(f"own.{node}") == F.col("other.node")) & F.col("own.doc_id").eqNullSafe(F.col("other.doc_id")), "left_semi")

    out = rows_of(kept.where("n = 1")).select(*docs.columns)
    repeated = kept.where("n > 1")
    if repeated.isEmpty():
        return out
    order = F.struct(*[F.to_json(c) if "map<" in docs.schema[c].dataType.simpleString() else F.col(c) for c in docs.columns])
    first = rows_of(repeated).groupBy(node, "doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return out.unionByName(first.select("row.*"))
