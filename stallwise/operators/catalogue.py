"""Item lifecycle, price bins, channels and devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grids import dense, ordered_axis
from ..functions.quantiles import bin_index, quantile_edges
from ..functions.scalar import cents, elapsed_days, safe_div, scalar_row, type_counts
from ..schemas import BEHAVIOR_TYPES, CHANNELS, DEVICE_TYPES
from ..settings import ITEM_STAGES, ItemLifeSettings
from .activity import pair_counts
from .revenue import _attribute_sales, _by_attribute, item_sales, paid_orders


def trend_slope(values: Column) -> Column:
    """Least-squares slope of an array over 0..n-1; short or all-zero arrays give 0."""
    n = F.size(values)
    centre = (n - 1) / 2.0
    indexed = F.transform(values, lambda y, i: F.struct((i - centre).alias("x"), y.cast("double").alias("y")))
    cov = F.aggregate(indexed, F.lit(0.0), lambda acc, p: acc + p["x"] * p["y"])
    var = F.aggregate(indexed, F.lit(0.0), lambda acc, p: acc + p["x"] * p["x"])
    total = F.aggregate(values, F.lit(0).cast("long"), lambda acc, y: acc + y)
    return F.when((n < 2) | (total == 0), F.lit(0.0)).otherwise(F.try_divide(cov, var))


def item_lifecycle(items: DataFrame, behaviors: DataFrame, order_items: DataFrame, orders: DataFrame,
                   cfg: ItemLifeSettings = ItemLifeSettings()) -> DataFrame:
    """Stage per item from its purchases in the last windows.

    By default only windows in which the item was seen form its trend; ``zero_fill`` uses all of them.
    """
    dated = behaviors.filter(F.col("event_date").isNotNull())
    as_of = scalar_row(dated, d=F.max("event_date"))["d"]
    index = F.floor((F.datediff("event_date", as_of) - 1 + cfg.windows * cfg.window_days) / cfg.window_days)
    seen = (
        dated.withColumn("w", index.cast("int")).filter(F.col("w") >= 0)
        .groupBy("item_id", "w").agg(*type_counts(types=("pv", "buy")))
        .groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("w", "buy", "pv"))).alias("s"))
    )
    trend = F.transform("s", lambda x: x["buy"])
    if cfg.zero_fill:
        def bought(i):
            hit = F.filter("s", lambda x: x["w"] == i)
            return F.when(F.size(hit) > 0, F.element_at(hit, 1)["buy"]).otherwise(F.lit(0).cast("long"))
        trend = F.array(*[bought(i) for i in range(cfg.windows)])
    seen = seen.select("item_id", trend.alias("buy_trend"),
                       F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["pv"]).alias("total_pv"))
    none = F.array_repeat(F.lit(0).cast("long"), cfg.windows)
    table = (
        items.select("item_id", "item_name", "price", "created_at")
        .join(seen, "item_id", "left")
        .join(item_sales(order_items, orders).select("item_id", "gmv"), "item_id", "left")
        .select(
            "item_id", "item_name", F.round("price", 2).alias("price"), "created_at",
            F.coalesce("buy_trend", none).alias("buy_trend"),
            F.coalesce("total_pv", F.lit(0)).alias("total_pv"),
            cents(F.coalesce("gmv", F.lit(0.0))).alias("total_gmv"))
        .withColumns({
            "slope": trend_slope(F.col("buy_trend")),
            "total_buy": F.aggregate("buy_trend", F.lit(0).cast("long"), lambda a, y: a + y),
            "recent": F.element_at("buy_trend", -1),
            "prev": F.when(F.size("buy_trend") > 1, F.try_element_at("buy_trend", F.lit(-2))).otherwise(0)})
    )
    age = elapsed_days(as_of.cast("timestamp_ntz"), "created_at")
    stage = (
        F.when(F.col("total_buy") == 0, "无购买")
        .when(age <= cfg.new_item_days, "新品")
        .when((F.col("prev") > 0) & (F.col("recent") <= F.col("prev") * cfg.decline_ratio), "衰退")
        .when((F.col("recent") > 0) & (F.col("slope") > cfg.growth_slope), "成长")
        .when(F.col("recent") >= cfg.hot_buys, "爆款")
        .otherwise("成熟"))
    return table.select("item_id", "item_name", "price", stage.alias("stage"), "buy_trend",
                        F.round("slope", 4).alias("slope"), "total_pv", "total_buy", "total_gmv")


def item_stage_distribution(staged: DataFrame) -> DataFrame:
    total = scalar_row(staged, n=F.count(F.lit(1)))["n"]
    counts = staged.groupBy("stage").agg(F.count(F.lit(1)).alias("count"),
                                         cents(F.sum("total_gmv")).alias("total_gmv"))
    axis = ordered_axis(staged.sparkSession, "stage", ITEM_STAGES)
    return dense(counts, axis, ["stage"], ["count", "total_gmv"]).select(
        "stage", "count", safe_div("count", total).alias("ratio"), "total_gmv")


def binned_items(items: DataFrame, bins: int) -> DataFrame:
    priced = items.select("item_id", F.col("price").cast("double").alias("price")).filter(F.col("price").isNotNull())
    return priced.withColumn("edges", quantile_edges(priced, "price", bins)).withColumn(
        "bin", bin_index(F.col("price"), F.col("edges")))


def price_bins(items: DataFrame, behaviors: DataFrame, order_items: DataFrame, orders: DataFrame,
               n_bins: int = 5) -> DataFrame:
    """Funnel, sales and buyer value per price bin, all bins."""
    binned = binned_items(items, n_bins)
    dim = binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.element_at(F.first("edges"), F.first("bin") + 1).alias("lo"),
        F.element_at(F.first("edges"), F.first("bin") + 2).alias("hi"))
    keyed = binned.select("item_id", "bin")
    counts = _by_attribute(pair_counts(behaviors), keyed, "bin").groupBy("bin").agg(
        *[F.sum(t).alias(t) for t in BEHAVIOR_TYPES])
    per_buyer = _attribute_sales(order_items, orders, keyed, "bin").groupBy("bin", "user_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("amount").alias("amount"))
    sales = per_buyer.groupBy("bin").agg(
        F.sum("orders").alias("orders"), cents(F.sum("amount")).alias("gmv"), F.count("user_id").alias("buy_users"))
    return (
        dim.join(counts, "bin", "left").join(sales, "bin", "left").fillna(0)
        .select(
            "bin", F.round("lo", 2).alias("price_min"), F.round("hi", 2).alias("price_max"), "item_count",
            "pv", "click", "cart", "buy", safe_div("click", "pv").alias("click_rate"),
            safe_div("cart", "pv").alias("cart_rate"), safe_div("buy", "pv").alias("buy_rate"), "orders", "gmv",
            "buy_users", safe_div("orders", "buy_users").alias("buy_freq"),
            F.round(safe_div("gmv", "buy_users"), 2).alias("user_value"))
    )


def top_price_bins(bins: DataFrame, top_n: int = 5) -> DataFrame:
    label = F.format_string("(%.2f, %.2f]", "price_min", "price_max")
    return bins.withColumn("bin_label", label).orderBy(F.desc("gmv"), "bin").limit(top_n)


def price_correlations(bins: DataFrame) -> DataFrame:
    def corr(name: str) -> Column:
        value = F.when(F.count(F.lit(1)) >= 3, F.corr("price_min", name))
        return F.round(F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)), 4)
    return bins.agg(
        F.count(F.lit(1)).alias("bins"), corr("buy_rate").alias("price_vs_buy_rate"),
        corr("buy_freq").alias("price_vs_buy_freq"), corr("user_value").alias("price_vs_user_value"))


def _segment_quality(behaviors: DataFrame, orders: DataFrame, column: str, users: DataFrame | None = None,
                     is_new: Column | None = None) -> DataFrame:
    """Per value of ``column``: users, counts and the paid orders of those who bought there.

    The log is reduced to (value, user) once; everything after that grows with users, not events.
    A buyer counts in every value they bought in, so these amounts must not be added up.
    """
    per_user = behaviors.groupBy(column, "user_id").agg(*type_counts(), F.count(F.lit(1)).alias("events"))
    paid = paid_orders(orders).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("o"), F.sum("total_amount").alias("g"))
    joined = per_user.join(paid, "user_id", "left")
    new_flag = F.lit(0)
    if users is not None:
        joined = joined.join(users.select("user_id", is_new.alias("_new")), "user_id", "left")
        new_flag = F.coalesce(F.col("_new").cast("int"), F.lit(0))
    bought = F.col("buy") > 0
    return joined.groupBy(column).agg(
        F.count("user_id").alias("users"), F.sum(new_flag).alias("new_users"), F.sum("events").alias("events"),
        *[F.sum(t).alias(t) for t in BEHAVIOR_TYPES],
        F.coalesce(F.sum(F.when(bought, F.col("o"))), F.lit(0)).alias("orders"),
        cents(F.coalesce(F.sum(F.when(bought, F.col("g"))), F.lit(0.0))).alias("gmv"))


def channel_analysis(users: DataFrame, behaviors: DataFrame, orders: DataFrame,
                     new_user_days: int = 30) -> DataFrame:
    dated = behaviors.filter(F.col("event_date").isNotNull())
    totals = scalar_row(dated.groupBy("user_id").agg(F.max("event_date").alias("d")),
                        as_of=F.max("d"), users=F.count("user_id"))
    is_new = F.datediff(totals["as_of"], F.to_date("register_time")) <= new_user_days
    table = _segment_quality(dated, orders, "channel", users, is_new)
    axis = ordered_axis(behaviors.sparkSession, "channel", CHANNELS)
    return dense(table, axis, ["channel"], [c for c in table.columns if c != "channel"]).select(
        "channel", "users", "new_users", safe_div("new_users", "users").alias("new_user_ratio"),
        safe_div("users", totals["users"]).alias("active_ratio"), *BEHAVIOR_TYPES,
        safe_div("click", "pv").alias("click_rate"), safe_div("buy", "pv").alias("buy_rate"), "orders", "gmv",
        safe_div("gmv", "orders").alias("aov"))


def device_analysis(behaviors: DataFrame, orders: DataFrame) -> DataFrame:
    table = _segment_quality(behaviors, orders, "device_type").drop("new_users")
    total = scalar_row(behaviors, n=F.count(F.lit(1)))["n"]
    hours = (
        behaviors.filter(F.col("event_hour") >= 0).groupBy("device_type", "event_hour")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("device_type").agg(
            F.sum("n").alias("timed"), F.sum(F.when(F.col("event_hour").between(18, 23), F.col("n"))).alias("evening"),
            F.min_by("event_hour", F.struct(-F.col("n"), "event_hour")).alias("peak_hour"))
    )
    axis = ordered_axis(behaviors.sparkSession, "device_type", DEVICE_TYPES)
    return (
        dense(table, axis, ["device_type"], [c for c in table.columns if c != "device_type"])
        .join(hours, "device_type", "left")
        .select(
            F.col("device_type").alias("device"), "users", safe_div("events", total).alias("behavior_ratio"),
            *BEHAVIOR_TYPES, safe_div("click", "pv").alias("click_rate"), safe_div("buy", "pv").alias("buy_rate"),
            "orders", "gmv", safe_div("gmv", "orders").alias("aov"),
            safe_div("evening", "timed").alias("evening_ratio"), "peak_hour")
    )
