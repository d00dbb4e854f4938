"""Running sums over a total order of a whole table, without one task that sees all rows.

The rows are range-partitioned and sorted by their keys, each task adds up its own range,
and the carry into each range follows from the last row of the ranges before it: one row a
range, summed on the driver. The sorted rows are stored before the carries are read, so a
task that runs again finds the same ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, stored

#: Sums of hashes are kept modulo 2**62, so that adding a carry cannot overflow.
MASK = (1 << 62) - 1
_PART, _AT, _GROUP = "_part", "_at", "_group"


def running_sums(df: DataFrame, order: list, sums: list[str], within: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` (less the columns of ``drop``) with each column of ``sums`` (long, not null) replaced by its sum modulo 2**62 up to and with the row.

    Rows go by ``order`` (columns or expressions over them); ``within`` names a long column without nulls, the first of ``order``,
    at whose changes the sums begin anew. Rows alike in all of ``order`` lie in one range, so keys that many rows share need
    another column after them. An empty table gives an empty table.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop(*drop)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema), f"{_PART} int", f"{_AT} long", f"{_GROUP} long"])
    names = placed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, group, carry = TaskContext.get().partitionId(), 0, 0, dict.fromkeys(sums, np.uint64(0))
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = b.column(within).to_numpy() if within else np.zeros(n, np.int64)
            begins = np.flatnonzero(np.concatenate(([at == 0 or keys[0] != group], keys[1:] != keys[:-1])))
            new = np.zeros(n, np.int64)
            new[begins] = 1
            run_of = np.cumsum(new)  # 0: goes on from the batch before
            columns = {c: b.column(c) for c in names}
            for c in sums:
                total = np.cumsum(b.column(c).to_numpy().astype(np.uint64))
                before = np.concatenate(([np.uint64(0) - carry[c]], total[begins] - b.column(c).to_numpy()[begins].astype(np.uint64)))
                own = (total - before[run_of]) & np.uint64(MASK)
                columns[c], carry[c] = pa.array(own.astype(np.int64)), own[-1]
            yield pa.RecordBatch.from_arrays(
                [*columns.values(), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(keys.astype(np.int64))],
                [*names, _PART, _AT, _GROUP],
            )
            at, group = at + n, keys[-1]

    local = stored(in_batches(placed, run, schema), "running-sums")
    ends = local.groupBy(_PART).agg(F.min_by(_GROUP, _AT).alias("first"), F.max_by(F.struct(_GROUP, *sums), _AT).alias("last")).collect()  # a row a range
    carries, group, carry = [], None, [0] * len(sums)
    for r in sorted(ends, key=lambda r: r[_PART]):
        goes_on = group == r["first"]
        if goes_on:
            carries.append((r[_PART], group, *carry))
        kept = carry if goes_on and r["last"][_GROUP] == r["first"] else [0] * len(sums)
        group, carry = r["last"][_GROUP], [(r["last"][c] + k) & MASK for c, k in zip(sums, kept)]
    added = spark.createDataFrame(carries, ", ".join(["_p int", "_g long", *(f"_c{i} long" for i in range(len(sums)))]))
    both = local.join(F.broadcast(added), (F.col(_PART) == F.col("_p")) & (F.col(_GROUP) == F.col("_g")), "left")
    with_carry = {c: (F.col(c) + F.coalesce(F.col(f"_c{i}"), F.lit(0))).bitwiseAND(F.lit(MASK)).alias(c) for i, c in enumerate(sums)}
    return both.select(*[with_carry.get(c, F.col(c)) for c in names])
