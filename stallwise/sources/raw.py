"""Raw text tables derived from a data folder, with the faults a shop export has.

Faults are placed by plain expressions on the keys, so SQL can repeat them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .worlds import category_table, event_columns, item_table, table, user_table


def _fault(index: str, every: int, faulty, normal):
    return F.when(F.col(index) % every == 0, F.lit(faulty)).otherwise(normal)


def _text(name: str):
    return F.col(name).cast("string")


def raw_behaviors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_columns(table(spark, sf_dir, "events")).withColumn("n", F.col("behavior_id"))
    stamp = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")
    return e.select(
        F.when(F.col("n") % 50 == 49, F.col("n") - 1).otherwise(F.col("n")).cast("string").alias("behavior_id"),
        _fault("n", 101, " ", _text("user_id")).alias("user_id"),
        _fault("n", 79, "99999999", _text("item_id")).alias("item_id"),
        F.concat(F.lit(" "), F.col("behavior_type"), F.lit(" ")).alias("behavior_type"),
        _fault("n", 97, "not a time", stamp).alias("event_time"),
        F.lit("1999-01-01").alias("event_date"),
        _fault("n", 89, "25", _text("event_hour")).alias("event_hour"),
        _fault("n", 83, "tv", _text("device_type")).alias("device_type"),
        "channel",
    )


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = user_table(spark, sf_dir).withColumn("n", F.col("user_id"))
    stamp = F.date_format("register_time", "yyyy-MM-dd HH:mm:ss")
    return u.select(
        F.when(F.col("n") % 40 == 39, F.col("n") - 1).otherwise(F.col("n")).cast("string").alias("user_id"),
        F.when(F.col("n") % 53 == 0, "abc").when(F.col("n") % 59 == 0, "70").otherwise(_text("age")).alias("age"),
        _fault("n", 61, "X", F.concat(F.col("gender"), F.lit(" "))).alias("gender"),
        "city",
        _fault("n", 67, "never", stamp).alias("register_time"),
        stamp.alias("created_at"),
        _fault("n", 71, "", stamp).alias("updated_at"),
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = item_table(spark, sf_dir).withColumn("n", F.col("item_id"))
    region = F.concat(F.lit("R"), (F.col("n") % 6).cast("string"))
    return i.select(
        _text("item_id").alias("item_id"), "item_name", region.alias("category_id"), "brand",
        _fault("n", 37, "-1", F.format_string("%.2f", "price")).alias("price"),
        _fault("n", 41, "many", _text("stock")).alias("stock"),
        _fault("n", 43, "2", _text("status")).alias("status"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("n", F.col("o_orderkey"))
    status = (F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "cancelled")
              .otherwise("refunded"))
    return o.select(
        _text("o_orderkey").alias("order_id"),
        _fault("n", 47, "88888888", _text("o_custkey")).alias("user_id"),
        F.date_format(F.col("o_orderdate") + F.expr("INTERVAL '25' YEAR"), "yyyy-MM-dd HH:mm:ss").alias("order_time"),
        _fault("n", 73, "-5", F.format_string("%.2f", "o_totalprice")).alias("total_amount"),
        status.alias("status"), F.col("o_orderpriority").alias("payment_method"),
    )


def raw_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines priced by quantity, so that equal lines of an order really are equal rows."""
    line = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_partkey"))
    return line.select(
        _text("l_orderkey").alias("order_id"), F.pmod(F.col("l_partkey"), F.lit(50)).cast("string").alias("item_id"),
        _fault("n", 31, "0", F.col("l_quantity").cast("long").cast("string")).alias("quantity"),
        F.lit("10").alias("unit_price"),
        (F.col("l_quantity").cast("long") * 10).cast("string").alias("amount"),
    )


def raw_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_table(spark, sf_dir)


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "categories": raw_categories(spark, sf_dir), "users": raw_users(spark, sf_dir),
        "items": raw_items(spark, sf_dir), "user_behaviors": raw_behaviors(spark, sf_dir),
        "orders": raw_orders(spark, sf_dir), "order_items": raw_order_items(spark, sf_dir),
    }
