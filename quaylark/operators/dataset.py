"""Labelled dataset: stratified sampling, quality rules, sections, scrubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed_unit(*parts: Column) -> Column:
    """A number in (0, 1) from SHA-256 of the parts: the same draw in every run and engine."""
    digits = F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float((1 << 48) + 2))


def clock(u: Column, weight: Column) -> Column:
    """Exponential clock: the smallest k of them are a weighted sample without replacement."""
    return -F.log1p(-u) / weight


def rarity(n: Column, most: Column, cap: float = 4.0) -> Column:
    return F.least(F.lit(cap), F.sqrt(most / n))


def one_per_group(df: DataFrame, group: str, draw: Column) -> DataFrame:
    w = Window.partitionBy(group).orderBy(draw)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def contiguous(ids: Column) -> Column:
    """An array of block numbers is a run without gaps or repeats."""
    s = F.array_sort(ids)
    return (F.size(s) > 0) & (F.size(F.array_distinct(s)) == F.size(s)) & (F.element_at(s, -1) - F.element_at(s, 1) == F.size(s) - 1)


def verdict(rules: dict[str, Column]) -> tuple[Column, Column]:
    """(accepted, names of failed rules joined by commas)."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return F.size(failed) == 0, F.array_join(failed, ",")


def window_size(n: int) -> int:
    """Rows that a sample of n is drawn from."""
    return min(50_000, max(10_000, 250 * n))


def agrees(a: Column, b: Column, tolerance: float) -> Column:
    """Two numbers within a tolerance, or both null."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= tolerance)
