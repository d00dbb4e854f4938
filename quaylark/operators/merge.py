"""Keyed merges as joins: what row stores do with INSERT ... ON CONFLICT and UPDATE ... FROM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_absent(target: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key the target lacks are added; of equal keys among them, one."""
    return target.unionByName(rows.dropDuplicates([*key]).join(target.select(*key), [*key], "left_anti"))


def upsert(target: DataFrame, rows: DataFrame, key: Sequence[str], coalesce: bool = True) -> DataFrame:
    """Full merge by key; with ``coalesce`` a null in ``rows`` keeps the stored value.

    A key that ``rows`` repeats would give its target row as often: reduce with ``last_of_each`` first.
    """
    t, r = target.alias("t"), rows.withColumn("_new", F.lit(True)).alias("r")
    both = t.join(r, [*key], "full_outer")
    rest = [c for c in target.columns if c not in key]
    new = lambda c: F.coalesce(F.col(f"r.{c}"), F.col(f"t.{c}")) if coalesce else F.when(F.col("r._new"), F.col(f"r.{c}")).otherwise(F.col(f"t.{c}"))
    return both.select(*key, *[new(c).alias(c) for c in rest])


def update_where(target: DataFrame, rows: DataFrame, key: Sequence[str], sets: dict[str, Column], guard: Column) -> DataFrame:
    """Columns of matched rows for which ``guard`` holds; rows alias n, target alias t; keys of ``rows`` are unique as in ``upsert``."""
    both = target.alias("t").join(rows.withColumn("_hit", F.lit(True)).alias("n"), [*key], "left")
    hit = F.coalesce(F.col("_hit") & guard, F.lit(False))
    cols = [F.when(hit, sets[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in sets else (F.col(c) if c in key else F.col(f"t.{c}").alias(c)) for c in target.columns]
    return both.select(*cols)


def toggled(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are on after an odd number of toggles."""
    return events.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1).select(*key)


def split_rejects(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and the others with the names of the failed ones."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("failed", failed)
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)


def last_of_each(rows: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """The row with the greatest ``order`` of each key, so that a merge meets every key once."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(*key, *[F.col("_last")[c].alias(c) for c in rest])
