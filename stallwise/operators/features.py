"""Feature tables over an observation window, for one window or for many at once."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import (cents, elapsed_days, micros_between, safe_div, scalar_row, type_counts,
                                weighted_counts)
from ..functions.sequence import with_previous
from ..schemas import BEHAVIOR_TYPES
from ..settings import FeatureSettings
from .revenue import paid_orders

# The columns of the feature contract, in its order.
USER_FEATURES = (
    "age", "gender_m", "gender_f", "register_days", "is_new_in_window", "total_behaviors",
    "n_pv", "n_click", "n_collect", "n_cart", "n_buy", "behavior_buy_ratio", "n_active_days", "active_day_ratio",
    "behaviors_per_active_day", "avg_behaviors_per_day", "n_sessions", "behaviors_per_session", "recency_days",
    "first_activity_offset_days", "n_distinct_items", "n_distinct_categories", "n_channels", "n_devices",
    "click_rate", "collect_rate", "cart_rate", "buy_rate", "paid_order_count", "paid_gmv", "avg_order_amount",
    "max_order_amount", "purchased_items", "purchased_categories", "purchase_days", "has_purchase",
)


def observation_window(behaviors: DataFrame, days: int, end: str | None = None) -> tuple[Column, Column]:
    """Closed window of ``days`` days; it ends on the given day or on the last day with data."""
    last = F.lit(end).cast("date") if end else scalar_row(behaviors, d=F.max("event_date"))["d"]
    return F.date_sub(last, days - 1), last


def days_array(days: list[date]) -> Column:
    return F.array(*[F.lit(d).cast("date") for d in days]).cast("array<date>")


def per_window(df: DataFrame, ends: list[date], holds) -> DataFrame:
    """Each row once per ``obs_end`` among ``ends`` for which ``holds(obs_end)`` is true."""
    return df.withColumn("obs_end", F.explode(F.filter(days_array(ends), holds)))


def span(ends: list[date], days: int) -> tuple[Column, Column]:
    """First and last day of all windows together, as literals: they prune files and reach the scan."""
    return F.lit(min(ends) - timedelta(days=days - 1)).cast("date"), F.lit(max(ends)).cast("date")


def windowed_user_features(users: DataFrame, behaviors: DataFrame, orders: DataFrame, order_items: DataFrame,
                           items: DataFrame, ends: list[date], days: int, gap_minutes: int = 30) -> DataFrame:
    """User features for every day in ``ends``, all windows in one job.

    Only the days that some window covers are read: an event whose predecessor lies before them opens a session anyway.
    Events are reduced to cells before the windows multiply them, and cells meet the windows by an expression, not by
    a join.  Sessions need no window function per snapshot either: an event opens one if its predecessor is too old
    or lies before the window.  Events without a time count, but belong to no session.  Orders use timestamps against
    midnight, so those placed later on the last day count for what comes next.
    """
    keys = ["user_id", "obs_end"]
    midnight = F.col("obs_end").cast("timestamp_ntz")
    start = F.date_sub("obs_end", days - 1)

    dim = items.select("item_id", "category_id").dropDuplicates(["item_id"])
    day = F.col("event_date")
    read = behaviors.filter(day.between(*span(ends, days))).select(
        "user_id", "item_id", "behavior_id", "behavior_type", "event_time", "event_date", "channel", "device_type")
    chained = with_previous(read.filter(F.col("event_time").isNotNull()), ["user_id"], "event_time", "behavior_id", ["event_time"])
    prev = F.col("_prev.event_time")
    opens = prev.isNull() | (micros_between("event_time", prev) > gap_minutes * 60_000_000)
    # an event that goes on with a session of an earlier day opens one in the windows that begin after that day
    timed = chained.withColumns({"opens": opens, "goes_on": F.when(~opens & (F.to_date(prev) < day), F.to_date(prev))})
    untimed = read.filter(F.col("event_time").isNull()).withColumns(
        {"opens": F.lit(False), "goes_on": F.lit(None).cast("date")})
    dims = ["event_date", "item_id", "channel", "device_type"]
    daily = timed.select("user_id", *dims, "behavior_type", "opens", "goes_on").unionByName(
        untimed.select("user_id", *dims, "behavior_type", "opens", "goes_on")
    ).groupBy("user_id", *dims, "goes_on").agg(
        *type_counts("n_"), F.count(F.lit(1)).alias("total_behaviors"), F.count_if("opens").alias("n_opens"))
    seen = per_window(daily, ends, lambda e: (day <= e) & (day >= F.date_sub(e, days - 1)))
    # One row per (user, window, day, item, channel, device): every count below is a sum over these.
    began = F.col("n_opens") + F.when(F.col("goes_on") < start, F.col("total_behaviors")).otherwise(0)
    cells = seen.groupBy(*keys, *dims).agg(
        *[F.sum(f"n_{t}").alias(f"n_{t}") for t in BEHAVIOR_TYPES], F.sum("total_behaviors").alias("total_behaviors"),
        F.sum(began).alias("n_sessions"))
    cells = cells.join(dim, "item_id", "left")
    n_types = [f"n_{t}" for t in BEHAVIOR_TYPES]
    activity = cells.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in (*n_types, "total_behaviors", "n_sessions")],
        F.countDistinct("event_date").alias("n_active_days"), F.countDistinct("item_id").alias("n_distinct_items"),
        F.countDistinct("category_id").alias("n_distinct_categories"), F.countDistinct("channel").alias("n_channels"),
        F.countDistinct("device_type").alias("n_devices"),
        F.max("event_date").alias("last_active"), F.min("event_date").alias("first_active"))

    def favourite(column: str, name: str) -> DataFrame:
        n = cells.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.sum("total_behaviors").alias("n"))
        return n.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("n"), column)).alias(name))

    first, last = span(ends, days)
    bought = per_window(
        paid_orders(orders).select("order_id", "user_id", "order_time", "total_amount")
        .filter(F.col("order_time").between(first.cast("timestamp_ntz"), last.cast("timestamp_ntz"))), ends,
        lambda e: F.col("order_time").between(F.date_sub(e, days - 1).cast("timestamp_ntz"), e.cast("timestamp_ntz")))
    spending = (
        bought.groupBy(*keys, F.to_date("order_time").alias("day"))
        .agg(F.count(F.lit(1)).alias("c"), F.sum("total_amount").alias("g"), F.max("total_amount").alias("m"))
        .groupBy(*keys).agg(F.sum("c").alias("paid_order_count"), cents(F.sum("g")).alias("paid_gmv"),
                            F.max("m").alias("max_order_amount"), F.count(F.lit(1)).alias("purchase_days"))
    )
    basket = (
        order_items.select("order_id", "item_id").join(bought.select("order_id", *keys), "order_id")
        .select(*keys, "item_id").distinct().join(dim, "item_id", "left")
        .groupBy(*keys).agg(F.count("item_id").alias("purchased_items"),
                            F.countDistinct("category_id").alias("purchased_categories"))
    )

    out = users.select("user_id", "age", "gender", "register_time").withColumn("obs_end", F.explode(days_array(ends)))
    for part in (activity, favourite("channel", "top_channel"), favourite("device_type", "top_device"),
                 spending, basket):
        out = out.join(part, keys, "left")
    zero = [*n_types, "total_behaviors", "n_sessions", "n_active_days", "n_distinct_items", "n_distinct_categories",
            "n_channels", "n_devices", "paid_order_count", "paid_gmv", "max_order_amount", "purchase_days",
            "purchased_items", "purchased_categories"]
    out = out.fillna(0, subset=zero).fillna("", subset=["top_channel", "top_device"])
    registered = F.col("register_time")
    out = out.withColumns({
        "gender_m": F.coalesce((F.col("gender") == "M").cast("int"), F.lit(0)),
        "gender_f": F.coalesce((F.col("gender") == "F").cast("int"), F.lit(0)),
        "register_days": F.greatest(F.coalesce(elapsed_days(midnight, registered), F.lit(0)), F.lit(0)),
        "is_new_in_window": F.coalesce(
            ((registered >= start.cast("timestamp_ntz")) & (registered <= midnight)).cast("int"), F.lit(0)),
        "recency_days": F.coalesce(F.datediff("obs_end", "last_active"), F.lit(days)),
        "first_activity_offset_days": F.coalesce(F.datediff("first_active", start), F.lit(0)),
        "behavior_buy_ratio": safe_div("n_buy", "total_behaviors"),
        "active_day_ratio": F.least(F.col("n_active_days") / F.lit(float(days)), F.lit(1.0)),
        "behaviors_per_active_day": safe_div("total_behaviors", "n_active_days"),
        "avg_behaviors_per_day": F.col("total_behaviors") / F.lit(float(days)),
        "behaviors_per_session": safe_div("total_behaviors", "n_sessions"),
        **{f"{t}_rate": safe_div(f"n_{t}", "n_pv") for t in BEHAVIOR_TYPES[1:]},
        "avg_order_amount": safe_div("paid_gmv", "paid_order_count"),
        "has_purchase": (F.col("paid_order_count") > 0).cast("int"),
    })
    return out.select("user_id", "obs_end", *USER_FEATURES, "top_channel", "top_device")


def user_features(users: DataFrame, behaviors: DataFrame, orders: DataFrame, order_items: DataFrame,
                  items: DataFrame, cfg: FeatureSettings = FeatureSettings()) -> DataFrame:
    """39 columns per user for one window."""
    end = date.fromisoformat(cfg.obs_end) if cfg.obs_end else behaviors.agg(F.max("event_date")).first()[0] or date(1970, 1, 1)
    return windowed_user_features(users, behaviors, orders, order_items, items, [end],
                                  cfg.observation_days, cfg.session_gap_minutes).drop("obs_end")


def _in_window(behaviors: DataFrame, start: Column, end: Column) -> DataFrame:
    return behaviors.filter(F.col("event_date").between(start, end))


def item_features(items: DataFrame, behaviors: DataFrame, order_items: DataFrame, orders: DataFrame,
                  cfg: FeatureSettings = FeatureSettings()) -> DataFrame:
    """22 columns per item for one window."""
    start, end = observation_window(behaviors, cfg.observation_days, cfg.obs_end)
    midnight = end.cast("timestamp_ntz")
    types = [f"n_{t}" for t in BEHAVIOR_TYPES]
    pairs = _in_window(behaviors, start, end).groupBy("item_id", "user_id").agg(
        *type_counts("n_"), F.max("event_date").alias("last_active"))
    activity = pairs.groupBy("item_id").agg(
        *[F.sum(c).alias(c) for c in types], F.count("user_id").alias("n_unique_users"),
        F.max("last_active").alias("last_active"))
    bought = paid_orders(orders).filter(F.col("order_time").between(start.cast("timestamp_ntz"), midnight))
    per_order = order_items.join(bought.select("order_id", "user_id"), "order_id").groupBy(
        "item_id", "user_id", "order_id").agg(F.sum("quantity").alias("q"), F.sum("amount").alias("a"))
    sales = (
        per_order.groupBy("item_id", "user_id").agg(F.sum("q").alias("q"), F.sum("a").alias("a"), F.count(F.lit(1)).alias("o"))
        .groupBy("item_id").agg(F.sum("q").alias("units_sold"), cents(F.sum("a")).alias("gmv"),
                                F.sum("o").alias("n_paid_orders"), F.count("user_id").alias("n_buying_users"))
    )
    out = (
        items.join(activity, "item_id", "left").join(sales, "item_id", "left")
        .fillna(0, subset=[*types, "n_unique_users", "units_sold", "gmv", "n_paid_orders", "n_buying_users"])
    )
    total = F.lit(0)
    for c in types:
        total = total + F.col(c)
    return out.select(
        "item_id", "item_name", "category_id", "brand", "price", "stock", "status",
        F.greatest(F.coalesce(elapsed_days(midnight, "created_at"), F.lit(0)), F.lit(0)).alias("days_listed"),
        *types, total.alias("total_behaviors"), "n_unique_users",
        F.coalesce(F.datediff(end, "last_active"), F.lit(cfg.observation_days)).alias("last_behavior_offset_days"),
        F.col("units_sold").cast("long").alias("units_sold"), "gmv", "n_paid_orders", "n_buying_users",
        safe_div("n_buy", "n_pv").alias("conversion_rate"),
        (weighted_counts(cfg.weights, "n_") + F.col("gmv") / 100.0).alias("heat_score"))


def user_item_features(behaviors: DataFrame, items: DataFrame, cfg: FeatureSettings = FeatureSettings()) -> DataFrame:
    """14 columns per (user, item) seen in the window."""
    start, end = observation_window(behaviors, cfg.observation_days, cfg.obs_end)
    types = [f"n_{t}" for t in BEHAVIOR_TYPES]
    pairs = _in_window(behaviors, start, end).groupBy("user_id", "item_id").agg(
        *type_counts("n_"), F.min("event_date").alias("first"), F.max("event_date").alias("last"))
    dim = items.select("item_id", "category_id").dropDuplicates(["item_id"])
    total = F.lit(0)
    for c in types:
        total = total + F.col(c)
    return pairs.join(dim, "item_id", "left").select(
        "user_id", "item_id", "category_id", *types, total.alias("total_behaviors"),
        weighted_counts(cfg.weights, "n_").alias("weighted_score"),
        F.datediff("first", start).alias("first_activity_offset_days"),
        F.datediff("last", start).alias("last_activity_offset_days"),
        F.datediff(end, "last").alias("days_since_last"), (F.col("n_buy") > 0).cast("int").alias("is_bought"))
