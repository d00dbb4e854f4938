"""Arrow batches cut by the size of their texts, so that what Python holds does not grow with the rows of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


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


def rows_of_texts(df: DataFrame, key: str, text: str, made: T.StructType, rows: Callable[[str | None], Iterable[tuple]]) -> DataFrame:
    """(key, the columns of ``made``): the rows that ``rows`` makes of each text, none or many.

    Texts are read and rows are given back by the megabyte. Repeated keys are rows of their own.
    """
    whole = T.StructType([T.StructField("_key", df.schema[key].dataType), *made])
    schema = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "_text"):
            at, out = [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                for row in rows(t):
                    at.append(i)
                    out.append(row)
            columns = zip(*out) if out else [[]] * len(schema)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(at, pa.int32())), *arrays], ["_key", *schema.names])

    return df.select(df[key].alias("_key"), df[text].cast("string").alias("_text")).mapInArrow(run, whole).withColumnRenamed("_key", key)
