"""The provided star-schema tables as cleaned point-of-sale tables: renamed columns, and one join where a
role needs columns of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import scan_parquet


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renamed_events(scan_parquet(spark, sf_dir, "events"))


def renamed_events(events: DataFrame) -> DataFrame:
    return events.select(_text("event_id").alias("transaction_id"), F.col("event_type").alias("store_id"), _text("user_id").alias("user_id"), F.col("value").alias("final_amount"), F.col("ts").alias("created_at"))


def order_transactions(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Several years of transactions; the customer's nation plays the store."""
    return as_orders(scan_parquet(spark, sf_dir, "orders"), scan_parquet(spark, sf_dir, "customer"), *more)


def as_orders(orders: DataFrame, customers: DataFrame, *more: str) -> DataFrame:
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(_text("o_orderkey").alias("transaction_id"), _text("c_nationkey").alias("store_id"), _text("o_custkey").alias("user_id"), F.col("o_totalprice").alias("final_amount"), F.col("o_orderdate").alias("created_at"), *more)


def line_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with many users per store; the supplier plays the store."""
    return as_line_transactions(scan_parquet(spark, sf_dir, "lineitem"), scan_parquet(spark, sf_dir, "orders"))


def as_line_transactions(lines: DataFrame, orders: DataFrame) -> DataFrame:
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    number = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return joined.select(number.alias("transaction_id"), _text("l_suppkey").alias("store_id"), _text("o_custkey").alias("user_id"), F.col("l_extendedprice").alias("final_amount"), F.col("l_shipdate").alias("created_at"))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_items(scan_parquet(spark, sf_dir, "lineitem"))


def numbered_items(lines: DataFrame) -> DataFrame:
    """Items whose ids stay numbers."""
    return as_items(lines).withColumn("item_id", F.col("item_id").cast("bigint"))


def as_items(lines: DataFrame, *more: Column) -> DataFrame:
    return lines.select(*more, _text("l_partkey").alias("item_id"), F.col("l_quantity").cast("bigint").alias("quantity"), F.col("l_extendedprice").alias("subtotal"), F.col("l_shipdate").alias("created_at"))


def part_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_parquet(spark, sf_dir, "part").select(_text("p_partkey").alias("item_id"), F.col("p_name").alias("item_name"))


def supplier_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_parquet(spark, sf_dir, "supplier").select(_text("s_suppkey").alias("store_id"), F.col("s_name").alias("store_name"))


def customer_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_parquet(spark, sf_dir, "customer").select(_text("c_custkey").alias("user_id"), F.col("c_name").alias("birthdate"))
