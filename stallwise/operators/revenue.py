"""Paid revenue, order status and ranking of items, categories and brands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grids import dense, ordered_axis
from ..functions.scalar import cents, safe_div, scalar_row, weighted_counts
from ..schemas import BEHAVIOR_TYPES, ORDER_STATUSES
from ..settings import BEHAVIOR_WEIGHTS
from .activity import pair_counts


def paid_orders(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status") == "paid")


def paid_lines(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines of paid orders, with their buyer."""
    buyers = paid_orders(orders).select("order_id", "user_id")
    return order_items.join(buyers, "order_id")


def _active_count(behaviors: DataFrame):
    users = behaviors.select("user_id").distinct()
    return scalar_row(users, n=F.count("user_id"))["n"]


def gmv_summary(orders: DataFrame, behaviors: DataFrame) -> DataFrame:
    """ARPU and paid rate divide by everybody who was ever active."""
    per_user = (
        paid_orders(orders).filter(F.col("order_time").isNotNull())
        .groupBy("user_id").agg(F.sum("total_amount").alias("gmv"), F.count(F.lit(1)).alias("orders"))
    )
    return (
        per_user.agg(cents(F.sum("gmv")).alias("g"), F.sum("orders").alias("order_count"),
                     F.count("user_id").alias("buying_users"))
        .withColumn("active_users", _active_count(behaviors))
        .select(
            F.coalesce("g", F.lit(0.0)).alias("gmv_total"),
            F.coalesce("order_count", F.lit(0)).alias("order_count"), "buying_users", "active_users",
            safe_div("g", "order_count").alias("aov"), safe_div("g", "active_users").alias("arpu"),
            safe_div("buying_users", "active_users").alias("paid_rate"),
        )
    )


def gmv_trend(orders: DataFrame, behaviors: DataFrame) -> DataFrame:
    """Day, week and month trends from one (user, day) reduction of the orders."""
    daily = (
        paid_orders(orders).filter(F.col("order_time").isNotNull())
        .groupBy("user_id", F.to_date("order_time").alias("day"))
        .agg(F.sum("total_amount").alias("gmv"), F.count(F.lit(1)).alias("orders"))
    )
    active = _active_count(behaviors)

    def grain(name: str, bucket, label) -> DataFrame:
        per_user = daily.groupBy("user_id", bucket.alias("b")).agg(
            F.sum("gmv").alias("gmv"), F.sum("orders").alias("orders"))
        return (
            per_user.groupBy("b").agg(cents(F.sum("gmv")).alias("g"), F.sum("orders").alias("orders"),
                                      F.count("user_id").alias("buying_users"))
            .select(F.lit(name).alias("grain"), label.alias("bucket"), F.col("g").alias("gmv"),
                    "orders", "buying_users", safe_div("g", "orders").alias("aov"),
                    safe_div("g", active).alias("arpu"))
        )

    day_label = F.date_format("b", "yyyy-MM-dd")
    return (
        grain("day", F.col("day"), day_label)
        .unionByName(grain("week", F.trunc("day", "week"), day_label))
        .unionByName(grain("month", F.trunc("day", "month"), F.date_format("b", "yyyy-MM")))
    )


def status_distribution(orders: DataFrame) -> DataFrame:
    counts = orders.filter(F.col("order_time").isNotNull()).groupBy("status").agg(
        F.count(F.lit(1)).alias("count"))
    axis = ordered_axis(orders.sparkSession, "status", ORDER_STATUSES)
    return dense(counts, axis, ["status"], ["count"]).select("status", "count")


def item_behavior(behaviors: DataFrame) -> DataFrame:
    """Per item: five counts and distinct users."""
    sums = [F.sum(t).alias(t) for t in BEHAVIOR_TYPES]
    return pair_counts(behaviors).groupBy("item_id").agg(
        *sums, F.count("user_id").alias("unique_users"))


def item_sales(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Per item over paid orders: quantity, distinct orders and amount."""
    per_order = paid_lines(order_items, orders).groupBy("item_id", "order_id").agg(
        F.sum("quantity").alias("q"), F.sum("amount").alias("a"))
    return per_order.groupBy("item_id").agg(
        F.sum("q").alias("sold"), F.count(F.lit(1)).alias("orders"), F.sum("a").alias("gmv"))


def item_ranking(items: DataFrame, behaviors: DataFrame, order_items: DataFrame,
                 orders: DataFrame, top_n: int = 10) -> DataFrame:
    """Top items by weighted behaviour plus a hundredth of their paid amount."""
    gmv = item_sales(order_items, orders).select("item_id", "gmv")
    table = (
        items.select("item_id", "item_name", "category_id", "brand", "price", "status")
        .join(item_behavior(behaviors), "item_id", "left")
        .join(gmv, "item_id", "left")
        .fillna(0, subset=[*BEHAVIOR_TYPES, "unique_users", "gmv"])
    )
    heat = F.round(weighted_counts(BEHAVIOR_WEIGHTS) + F.col("gmv") / 100.0, 6)
    return (
        table.withColumn("heat", heat).orderBy(F.desc("heat"), "item_id").limit(top_n)
        .select(
            "item_id", "item_name", "category_id", "brand", F.round("price", 2).alias("price"), "status",
            *BEHAVIOR_TYPES, F.round("gmv", 2).alias("gmv"), "unique_users",
            safe_div("buy", "pv").alias("conversion_rate"),
            F.round("heat", 2).alias("heat_score"),
        )
    )


def _by_attribute(pairs: DataFrame, items: DataFrame, attribute: str) -> DataFrame:
    """Pair counts lifted from items to an attribute of the item, one row per (attribute, user)."""
    dim = items.select("item_id", attribute).filter(F.col(attribute).isNotNull())
    return pairs.join(dim, "item_id").groupBy(attribute, "user_id").agg(
        *[F.sum(t).alias(t) for t in BEHAVIOR_TYPES])


def _attribute_sales(order_items, orders, items, attribute: str) -> DataFrame:
    """Paid lines reduced to (attribute, order) before the per-attribute totals."""
    dim = items.select("item_id", attribute).filter(F.col(attribute).isNotNull())
    return paid_lines(order_items, orders).join(dim, "item_id").groupBy(
        attribute, "order_id", "user_id"
    ).agg(F.sum("amount").alias("amount"), F.sum("quantity").alias("quantity"))


def category_ranking(items: DataFrame, behaviors: DataFrame, order_items: DataFrame,
                     orders: DataFrame, top_n: int = 10) -> DataFrame:
    """Categories by paid amount; those without sales or behaviour still take part."""
    counts = _by_attribute(pair_counts(behaviors), items, "category_id").groupBy("category_id").agg(
        F.count("user_id").alias("users"), *[F.sum(t).alias(t) for t in BEHAVIOR_TYPES])
    sales = _attribute_sales(order_items, orders, items, "category_id").groupBy("category_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("amount").alias("gmv"))
    return (
        items.select("category_id").filter(F.col("category_id").isNotNull()).distinct()
        .join(counts, "category_id", "left").join(sales, "category_id", "left")
        .fillna(0)
        .select("category_id", "users", *BEHAVIOR_TYPES, "orders", F.round("gmv", 2).alias("gmv"),
                safe_div("buy", "pv").alias("conversion_rate"))
        .orderBy(F.desc("gmv"), "category_id").limit(top_n)
    )


def brand_ranking(items: DataFrame, behaviors: DataFrame, order_items: DataFrame,
                  orders: DataFrame, top_n: int = 10) -> DataFrame:
    """Brands with paid sales, by paid amount."""
    users = _by_attribute(pair_counts(behaviors), items, "brand").groupBy("brand").agg(
        F.count("user_id").alias("users"))
    per_order = _attribute_sales(order_items, orders, items, "brand")
    per_buyer = per_order.groupBy("brand", "user_id").agg(
        F.sum("amount").alias("amount"), F.sum("quantity").alias("quantity"),
        F.count(F.lit(1)).alias("orders"))
    sales = per_buyer.groupBy("brand").agg(
        cents(F.sum("amount")).alias("g"), F.sum("quantity").cast("double").alias("sold"),
        F.count("user_id").alias("buy_users"), F.sum("orders").alias("orders"))
    return (
        sales.join(users, "brand", "left").fillna(0, subset=["users", "sold"])
        .select("brand", F.col("g").alias("gmv"), "sold", "buy_users", "orders", "users",
                F.round(safe_div("g", "orders"), 2).alias("aov"))
        .orderBy(F.desc("gmv"), "brand").limit(top_n)
    )
