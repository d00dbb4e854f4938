"""Facets, histograms and counts over filtered postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facet(df: DataFrame, value: str, count: str = "n") -> DataFrame:
    """Exhaustive counts of a scalar column; null is no value."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias(count))


def facet_array(df: DataFrame, value: str, alias: str, count: str = "n") -> DataFrame:
    """Exhaustive counts of the values of an array column, each once a row."""
    return facet(df.select(F.explode(F.array_distinct(value)).alias(alias)), alias, count)


def top(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Page of the size ``limit`` that holds ``offset``: offsets within a page are rounded down."""
    return top(df, order, limit, offset // limit * limit)


def histogram(df: DataFrame, value: Column, width: float, bins: int, alias: str = "bin", count: str = "n") -> DataFrame:
    """Half-open bins of one width; the last is open. Empty bins are absent."""
    at = F.least(F.floor(value / width), F.lit(bins)).cast("long")
    return df.where(value.isNotNull() & (value >= 0)).groupBy(at.alias(alias)).agg(F.count("*").alias(count))


def integer_facet(df: DataFrame, value: str, values: int, count: str = "n") -> DataFrame:
    """The most frequent integers of 0 or more, in their own order."""
    return top(facet(df.where(F.col(value) >= 0), value, count), [F.desc(count), F.asc(value)], values).orderBy(value)


def with_zeros(authority: DataFrame, counts: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Every key of ``authority`` with its counts; 0 where there are none."""
    return authority.join(counts, key, "left").fillna(0, list(columns))


def group_top(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their rank."""
    from pyspark.sql import Window

    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)
