"""User and item profiles, and the facts behind the findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cents, elapsed_days, safe_div, scalar_row, type_counts, weighted_counts
from ..schemas import BEHAVIOR_TYPES
from ..settings import (BEHAVIOR_WEIGHTS, ItemLifeSettings, LifecycleSettings, PRICE_BANDS, RfmSettings, SPEND_LOW,
                        SPEND_NONE, SPEND_TIERS)
from .catalogue import item_lifecycle
from .revenue import item_behavior, item_sales, paid_orders
from .value import rfm, user_lifecycle


def group_mode(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Most frequent value per key, the smallest on ties; nulls do not count."""
    counts = df.select(key, value.alias(name)).filter(F.col(name).isNotNull()).groupBy(key, name).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min_by(name, F.struct(-F.col("n"), name)).alias(name))


def group_top(counts: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The ``n`` values with the highest count per key, value ascending on ties."""
    w = Window.partitionBy(key).orderBy(F.desc("count"), value)
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _attribute_counts(behaviors: DataFrame, items: DataFrame, attribute: str) -> DataFrame:
    pairs = behaviors.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("c"))
    dim = items.select("item_id", attribute).filter(F.col(attribute).isNotNull())
    return pairs.join(dim, "item_id").groupBy("user_id", attribute).agg(F.sum("c").alias("count"))


def preferences(behaviors: DataFrame, items: DataFrame, attribute: str, top_n: int = 3) -> DataFrame:
    return group_top(_attribute_counts(behaviors, items, attribute), "user_id", attribute, top_n)


def _preference_list(behaviors, items, attribute: str, top_n: int, name: str) -> DataFrame:
    top = preferences(behaviors, items, attribute, top_n)
    return top.groupBy("user_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", attribute, "count"))),
        lambda x: F.struct(x[attribute].cast("string").alias("value"), x["count"].alias("count"))).alias(name))


def spend_tier(gmv) -> Column:
    out = F.when(gmv > 0, F.lit(SPEND_LOW)).otherwise(F.lit(SPEND_NONE))
    for label, bound in reversed(SPEND_TIERS):
        out = F.when(gmv >= bound, F.lit(label)).otherwise(out)
    return out


def user_profile(users: DataFrame, behaviors: DataFrame, orders: DataFrame, order_items: DataFrame,
                 items: DataFrame, top_n: int = 3, rfm_cfg: RfmSettings = RfmSettings(),
                 life_cfg: LifecycleSettings = LifecycleSettings()) -> DataFrame:
    """One row per user, every part reduced to users before the joins."""
    life = user_lifecycle(users, behaviors, orders, life_cfg).select("user_id", F.col("stage").alias("lifecycle_stage"))
    scores = rfm(orders, rfm_cfg).select("user_id", F.struct(
        "r_score", "f_score", "m_score", "rfm_score", "segment").alias("rfm"))
    counts = (
        behaviors.groupBy("user_id", "event_date").agg(*type_counts())
        .groupBy("user_id").agg(*[F.sum(t).alias(t) for t in BEHAVIOR_TYPES], F.count("event_date").alias("active_days"))
    )
    paid = paid_orders(orders).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("order_count"), cents(F.sum("total_amount")).alias("gmv"))
    as_of = scalar_row(behaviors, d=F.max("event_date"))["d"].cast("timestamp_ntz")
    hour = F.coalesce(F.col("event_hour").cast("int"), F.lit(-1))
    parts = [
        counts, paid, life, scores,
        group_mode(behaviors, "user_id", hour, "peak_hour"),
        group_mode(behaviors, "user_id", F.weekday("event_date"), "peak_weekday"),
        group_mode(behaviors, "user_id", F.col("channel"), "channel"),
        group_mode(behaviors, "user_id", F.col("device_type"), "device"),
        _preference_list(behaviors, items, "category_id", top_n, "preferred_categories"),
        _preference_list(behaviors, items, "brand", top_n, "preferred_brands"),
    ]
    joined = reduce(lambda left, right: left.join(right, "user_id", "left"), parts, users)
    joined = joined.fillna(0, subset=[*BEHAVIOR_TYPES, "active_days", "order_count", "gmv"])
    return joined.select(
        "user_id",
        F.struct("age", "gender", "city", elapsed_days(as_of, "register_time").alias("register_days")).alias("basic"),
        F.struct(*BEHAVIOR_TYPES, "active_days").alias("behavior"),
        F.struct("order_count", "gmv", safe_div("gmv", "order_count").alias("aov")).alias("purchase"),
        spend_tier(F.col("gmv")).alias("spending_power"),
        F.struct("peak_hour", "peak_weekday").alias("active_time"),
        F.coalesce("preferred_categories", F.array().cast("array<struct<value:string,count:bigint>>")).alias("preferred_categories"),
        F.coalesce("preferred_brands", F.array().cast("array<struct<value:string,count:bigint>>")).alias("preferred_brands"),
        "lifecycle_stage", "rfm", "channel", "device")


def price_band(price, q1, q3) -> Column:
    free, low, middle, high = PRICE_BANDS
    return F.when(price <= 0, free).when(price <= q1, low).when(price <= q3, middle).otherwise(high)


def item_profile(items: DataFrame, behaviors: DataFrame, order_items: DataFrame, orders: DataFrame,
                 cfg: ItemLifeSettings = ItemLifeSettings()) -> DataFrame:
    """Heat here is the weighted behaviour alone; the ranking adds a share of the paid amount."""
    stages = item_lifecycle(items, behaviors, order_items, orders, cfg).select(
        "item_id", F.col("stage").alias("lifecycle_stage"))
    quartiles = items.agg(F.percentile(F.col("price").cast("double"), F.array(F.lit(0.25), F.lit(0.75))).alias("q")).scalar()
    joined = (
        items.join(item_behavior(behaviors), "item_id", "left")
        .join(item_sales(order_items, orders), "item_id", "left").join(stages, "item_id", "left")
        .fillna(0, subset=[*BEHAVIOR_TYPES, "unique_users", "sold", "orders", "gmv"])
        .withColumn("q", quartiles)
    )
    price = F.coalesce("price", F.lit(0.0))
    return joined.select(
        "item_id", "item_name",
        F.struct("category_id", "brand", F.round(price, 2).alias("price"), "stock", "status", "created_at").alias("basic"),
        F.struct(*BEHAVIOR_TYPES, "unique_users", safe_div("buy", "pv").alias("conversion_rate")).alias("behavior"),
        F.struct(F.col("sold").cast("double").alias("sold"), "orders", cents("gmv").alias("gmv")).alias("sales"),
        "lifecycle_stage", price_band(price, F.col("q")[0], F.col("q")[1]).alias("price_band"),
        F.round(weighted_counts(BEHAVIOR_WEIGHTS), 2).alias("heat_score"))


def fact(df: DataFrame, domain: str, metric: str, label, value, best_by=None) -> DataFrame:
    """A result reduced to one telling row ``(domain, metric, label, value)``."""
    row = F.struct(F.lit(domain).alias("domain"), F.lit(metric).alias("metric"),
                   label.cast("string").alias("label"), value.cast("double").alias("value"))
    if best_by is None:
        return df.select("*", row.alias("f")).select("f.*")
    return df.agg(F.max_by(row, best_by).alias("f")).select("f.*")


def findings(results: dict[str, DataFrame]) -> DataFrame:
    """The telling rows of fourteen results, by the names ``analyses`` gives them; results that are absent or empty are left out.

    ``item_ranking`` and ``top_paths`` are given cut to their first row.
    """
    c = F.col
    rules = {
        "user_scale": lambda d: fact(d, "user_scale", "pay_rate", F.lit("all"), c("pay_rate")),
        "funnel": lambda d: fact(d.filter("step > 1"), "funnel", "step_conversion_rate", c("stage"), c("step_conversion_rate")),
        "retention": lambda d: fact(d, "retention", "rate", c("offset"), c("rate")),
        "cohort_aggregate": lambda d: fact(d, "cohort", "day_1", c("total_cohorts"), c("day_1")),
        "rfm_segments": lambda d: fact(d, "rfm", "count", c("segment"), c("count")),
        "lifecycle": lambda d: fact(d, "lifecycle", "ratio", c("stage"), c("ratio")),
        "top_paths": lambda d: fact(d, "purchase_path", "sessions", c("path"), c("sessions")),
        "item_ranking": lambda d: fact(d, "item_ranking", "heat_score", c("item_name"), c("heat_score")),
        "item_stages": lambda d: fact(d, "item_lifecycle", "count", c("stage"), c("count")),
        "price_bins": lambda d: fact(d, "price", "buy_rate", c("bin"), c("buy_rate"), F.struct("buy_rate", -c("bin"))),
        "channels": lambda d: fact(d, "channel", "buy_rate", c("channel"), c("buy_rate"), F.struct("buy_rate", "channel")),
        "devices": lambda d: fact(d.filter("device = 'mobile'"), "device", "behavior_ratio", c("device"), c("behavior_ratio")),
        "item_rules": lambda d: fact(d, "association", "lift", F.concat_ws(" + ", "antecedent", "consequent"), c("lift"),
                                     F.struct("lift", "antecedent", "consequent")),
        "segment_names": lambda d: fact(d, "segmentation", "size", c("cluster_name"), c("size"), F.struct("size", "cluster_id")),
    }
    return reduce(DataFrame.unionByName, [rule(results[name]) for name, rule in rules.items() if name in results]).filter("domain is not null")
