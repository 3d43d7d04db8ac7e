"""The driver's tables in the shapes that the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def brand_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by brands: quantity bought."""
    line = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    part = read(spark, sf, "part").select("p_partkey", "p_brand")
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(part, line.l_partkey == part.p_partkey)
    return joined.groupBy(F.col("o_custkey").alias("cell"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("batch"), F.col("c_acctbal").alias("balance"))


def brands(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_brand").alias("gene")).distinct()


def event_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Users by event types: sum of values."""
    return read(spark, sf, "events").groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("gene")).agg(F.sum("value").alias("value"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(F.col("user_id").alias("cell")).distinct().withColumn("grp", F.concat(F.lit("g"), (F.col("cell") % 3).cast("string")))


BRAND_X = "x AS (SELECT o_custkey AS cell, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
CUSTOMERS = "obs AS (SELECT c_custkey AS cell, c_mktsegment AS segment, c_nationkey AS batch, c_acctbal AS balance FROM customer)"
BRANDS = "var AS (SELECT DISTINCT p_brand AS gene FROM part)"
EVENT_X = "x AS (SELECT user_id AS cell, event_type AS gene, sum(value) AS value FROM events GROUP BY 1, 2)"
USERS = "obs AS (SELECT DISTINCT user_id AS cell, 'g' || (user_id % 3) AS grp FROM events)"
