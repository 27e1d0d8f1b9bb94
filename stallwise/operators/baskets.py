"""Association rules between two items, or two categories, of the same paid order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pairing import both_ways, pair_sums
from ..functions.scalar import scalar_row
from ..session import cut_lineage
from ..settings import BasketSettings
from .revenue import paid_lines


def pair_rules(baskets: DataFrame, member: str, total_orders, cfg: BasketSettings) -> DataFrame:
    """Rules from distinct (order_id, member) rows.

    Members below the support limit go first.  At most (mean basket size / min_support) members
    can reach it, so what is left of even the largest order is bounded by the limit, not by the data.
    """
    n = scalar_row(baskets.groupBy("order_id").agg(F.count(F.lit(1)).alias("k")), n=F.count(F.lit(1)))["n"]
    frequent = cut_lineage(
        baskets.groupBy(member).agg(F.count(F.lit(1)).alias("n_one"))
        .filter(F.col("n_one") / n >= cfg.min_support)
    )
    pairs = pair_sums(baskets.join(frequent.select(member), member, "left_semi"), "order_id", member)
    rules = (
        both_ways(pairs.filter(F.col("shared") / n >= cfg.min_support))
        .join(frequent.select(F.col(member).alias("a"), F.col("n_one").alias("n_a")), "a")
        .join(frequent.select(F.col(member).alias("b"), F.col("n_one").alias("n_b")), "b")
        .select("a", "b", (F.col("shared") / n).alias("support"), (F.col("shared") / F.col("n_a")).alias("confidence"),
                "n_b")
        .withColumn("lift", F.round(F.col("confidence") / (F.col("n_b") / n), 9))
        .filter((F.col("lift") >= cfg.min_lift) & (F.col("confidence") >= cfg.min_confidence))
    )
    return rules.orderBy(F.desc("lift"), "a", "b").limit(cfg.top_n).select(
        "a", "b", F.round("support", 4).alias("support"), F.round("confidence", 4).alias("confidence"),
        F.round("lift", 4).alias("lift"), F.round(F.col("support") * total_orders).cast("long").alias("count"))


def _order_items_once(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Written once: members, pairs and totals all start from it."""
    return cut_lineage(paid_lines(order_items, orders).select("order_id", "item_id").distinct())


def _total_orders(baskets: DataFrame):
    return scalar_row(baskets.select("order_id").distinct(), n=F.count(F.lit(1)))["n"]


def item_rules(order_items: DataFrame, orders: DataFrame, items: DataFrame,
               cfg: BasketSettings = BasketSettings()) -> DataFrame:
    baskets = _order_items_once(order_items, orders)
    rules = pair_rules(baskets, "item_id", _total_orders(baskets), cfg)
    names = items.select("item_id", "item_name")
    a = names.select(F.col("item_id").alias("a"), F.col("item_name").alias("antecedent"))
    b = names.select(F.col("item_id").alias("b"), F.col("item_name").alias("consequent"))
    return rules.join(a, "a", "left").join(b, "b", "left").select(
        F.col("a").alias("antecedent_id"), F.col("b").alias("consequent_id"),
        F.coalesce("antecedent", F.col("a").cast("string")).alias("antecedent"),
        F.coalesce("consequent", F.col("b").cast("string")).alias("consequent"),
        "support", "confidence", "lift", "count")


def category_rules(order_items: DataFrame, orders: DataFrame, items: DataFrame,
                   cfg: BasketSettings = BasketSettings()) -> DataFrame:
    """Support is over orders with a known category; ``count`` scales it to all paid orders."""
    baskets = _order_items_once(order_items, orders)
    dim = items.select("item_id", "category_id").filter(F.col("category_id").isNotNull())
    by_category = cut_lineage(baskets.join(dim, "item_id").select("order_id", "category_id").distinct())
    rules = pair_rules(by_category, "category_id", _total_orders(baskets), cfg)
    return rules.select(F.concat(F.lit("分类"), "a").alias("antecedent"), F.concat(F.lit("分类"), "b").alias("consequent"),
                        "support", "confidence", "lift", "count")
