"""Reading the input tables under the names of the posting model.

orders are postings of companies (customers) in places (nation, region); parts carry
the taxonomy; events are the log of crawls and of applications; pages and documents
are the scraped content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a posting: id, company_id, status, is_active, salary, first_seen, seniority."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("company_id"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_orderstatus") != "F").alias("is_active"),
        F.col("o_totalprice").alias("salary"),
        F.col("o_orderdate").alias("first_seen"),
        F.col("o_orderpriority").alias("seniority"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company_id, name, place_id, balance, industry."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("company_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("place_id"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("industry"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place tree as (id, parent_id, name, kind); regions are 1000 + their key."""
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("id"), F.lit(None).cast("int").alias("parent_id"), F.col("r_name").alias("name"), F.lit("region").alias("kind"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") + 1000).alias("parent_id"), F.col("n_name").alias("name"), F.lit("country").alias("kind"))
    return region.unionByName(nation)


def money(c: str | Column) -> Column:
    """Exact decimals for sums, so that the order of addition cannot show."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def total(c: str | Column) -> Column:
    return F.sum(money(c)).cast("double")


#: The same views in SQL.
POSTINGS = """(SELECT o_orderkey AS id, o_custkey AS company_id, o_orderstatus AS status, o_orderstatus <> 'F' AS is_active,
 o_totalprice AS salary, o_orderdate AS first_seen, o_orderpriority AS seniority FROM orders)"""
COMPANIES = "(SELECT c_custkey AS company_id, c_name AS name, c_nationkey AS place_id, c_acctbal AS balance, c_mktsegment AS industry FROM customer)"
PLACES = """(SELECT r_regionkey + 1000 AS id, NULL::INTEGER AS parent_id, r_name AS name, 'region' AS kind FROM region
 UNION ALL SELECT n_nationkey, n_regionkey + 1000, n_name, 'country' FROM nation)"""
