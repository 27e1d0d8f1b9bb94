"""Shop tables derived from the order and event tables of a data folder.

Two worlds share users, items and behaviours.  In the event world every purchase event
is an order of one line; in the order world orders and lines are the order tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHANNELS, DEVICE_TYPES
from ..session import pin_utc


@dataclass(frozen=True)
class World:
    users: DataFrame
    items: DataFrame
    behaviors: DataFrame
    orders: DataFrame
    order_items: DataFrame
    categories: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index, values):
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(index == i, F.lit(v)).otherwise(out)
    return out


def event_columns(events: DataFrame) -> DataFrame:
    """Behaviour columns of an event table; works on a batch and on a stream."""
    return events.select(
        F.col("event_id").alias("behavior_id"),
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        F.when(F.col("event_type") == "view", "pv")
        .when(F.col("event_type") == "purchase", "buy")
        .otherwise(F.col("event_type")).alias("behavior_type"),
        F.col("ts").alias("event_time"),
        F.to_date("ts").alias("event_date"),
        F.hour("ts").alias("event_hour"),
        _pick(F.col("event_id") % 3, DEVICE_TYPES).alias("device_type"),
        _pick(F.col("event_id") % 5, CHANNELS).alias("channel"),
    )


def event_orders(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("order_id"),
        "user_id",
        F.col("ts").alias("order_time"),
        F.col("value").alias("total_amount"),
        F.when(F.col("event_id") % 10 < 8, "paid")
        .when(F.col("event_id") % 10 == 8, "cancelled")
        .otherwise("refunded").alias("status"),
    )


def event_order_lines(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("order_id"),
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        F.lit(1).cast("long").alias("quantity"),
        F.col("value").alias("unit_price"),
        F.col("value").alias("amount"),
    )


def user_table(spark, sf_dir) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        key.alias("user_id"),
        F.when(key % 11 != 0, F.lit(18) + key % 43).cast("int").alias("age"),
        F.when(key % 3 == 0, "M").when(key % 3 == 1, "F").alias("gender"),
        F.when(key % 7 != 0, F.col("n_name")).alias("city"),
        F.expr("TIMESTAMP_NTZ '2023-12-01 00:00:00' + make_dt_interval(int(c_custkey % 60), int(c_custkey % 24))")
        .alias("register_time"),
    )


def item_table(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.col("p_type").alias("category_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("stock"),
        F.when(F.col("p_partkey") % 10 == 0, 0).otherwise(1).alias("status"),
        F.expr("TIMESTAMP_NTZ '2023-11-01 00:00:00' + make_dt_interval(int(p_partkey % 90), int(p_partkey % 24))")
        .alias("created_at"),
    )


def category_table(spark, sf_dir) -> DataFrame:
    """Two levels: regions on top, their nations below."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = region.select(
        F.concat(F.lit("R"), F.col("r_regionkey")).alias("category_id"),
        F.col("r_name").alias("category_name"),
        F.lit(None).cast("string").alias("parent_id"),
    )
    leaf = nation.select(
        F.concat(F.lit("N"), F.col("n_nationkey")).alias("category_id"),
        F.col("n_name").alias("category_name"),
        F.concat(F.lit("R"), F.col("n_regionkey")).alias("parent_id"),
    )
    return top.unionByName(leaf)


def event_world(spark: SparkSession, sf_dir: str) -> World:
    events = table(spark, sf_dir, "events")
    return World(
        users=user_table(spark, sf_dir),
        items=item_table(spark, sf_dir),
        behaviors=event_columns(events),
        orders=event_orders(events),
        order_items=event_order_lines(events),
        categories=category_table(spark, sf_dir),
    )


def order_world(spark: SparkSession, sf_dir: str) -> World:
    events = table(spark, sf_dir, "events")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("order_time"),
        F.col("o_totalprice").alias("total_amount"),
        F.when(F.col("o_orderstatus") == "F", "paid")
        .when(F.col("o_orderstatus") == "O", "cancelled")
        .otherwise("refunded").alias("status"),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"),
        F.col("l_extendedprice").alias("amount"),
    )
    return World(
        users=user_table(spark, sf_dir),
        items=item_table(spark, sf_dir),
        behaviors=event_columns(events),
        orders=orders,
        order_items=lines,
        categories=category_table(spark, sf_dir),
    )
