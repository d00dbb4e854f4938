"""Publishing: change slices by cursor, commit-safe cutoffs, documents, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bucket256


def after(cursor_time: Column, cursor_id: Column, time: str = "updated_at", key: str = "id") -> Column:
    """Rows strictly behind a cursor of (time, id)."""
    return (F.col(time) > cursor_time) | ((F.col(time) == cursor_time) & (F.col(key) > cursor_id))


def cdc_slice(rows: DataFrame, cursor_time: Column, cursor_id: Column, cutoff: Column, limit: int) -> DataFrame:
    """The next ``limit`` changed rows behind the cursor and before the cutoff, in order.

    The cutoff is the start of the oldest writer that is still open: rows it commits later
    cannot lie before a cursor that has moved on.
    """
    return rows.where(after(cursor_time, cursor_id) & (F.col("updated_at") < cutoff)).orderBy("updated_at", "id").limit(limit)


def two_cursors(rows: DataFrame, first: tuple[Column, Column], second: tuple[Column, Column]) -> DataFrame:
    """One read behind the lesser of two cursors; flags say which target still needs a row."""
    a, b = after(*first), after(*second)
    return rows.where(a | b).withColumns({"for_first": a, "for_second": b})


def repairs(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(id, bucket, action) that make a remote copy equal: upsert or delete."""
    both = local.alias("l").join(remote.alias("r"), F.col("l.id") == F.col("r.id"), "full_outer")
    action = F.when(F.col("l.id").isNull(), "delete").when(F.col("r.id").isNull() | (F.col("l.is_active") != F.col("r.is_active")) | (F.col("l.fingerprint") != F.col("r.fingerprint")), "upsert")
    key = F.coalesce("l.id", "r.id")
    return both.select(key.alias("id"), bucket256(F.sha2(key.cast("string"), 256)).alias("bucket"), action.alias("action")).where("action IS NOT NULL")


def guarded_prune(rows: DataFrame, doomed: DataFrame, key: str, most: int = 50, share: float = 0.01) -> DataFrame:
    """Rows without the doomed ones, unless those are too many; then all rows stay."""
    n, total = doomed.count(), rows.count()
    return rows.join(doomed, key, "left_anti") if n <= most and n <= total * share else rows


def stamped(old: Column, new_time: Column, changed: Column) -> Column:
    """The change time moves only where an exported column changed."""
    return F.when(changed, new_time).otherwise(old)
