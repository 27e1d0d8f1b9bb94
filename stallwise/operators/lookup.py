"""Table queries behind the read side: search, paging, histories and overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cents, scalar_row
from .activity import latest_active_users, user_scale
from .profiles import item_profile
from .revenue import gmv_summary, paid_orders


def _page(found: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """One page in a stable order, with the number of all matches on every row."""
    total = scalar_row(found, n=F.count(F.lit(1)))["n"]
    return found.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def search_users(users: DataFrame, keyword: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Case-insensitive pattern on user id or city."""
    if keyword:
        pattern = f"(?i){keyword}"
        users = users.filter(F.col("user_id").cast("string").rlike(pattern)
                             | F.coalesce(F.col("city").rlike(pattern), F.lit(False)))
    return _page(users, ["user_id"], limit, offset)


SORTS = {
    "price": [F.asc_nulls_last, "price"], "-price": [F.desc_nulls_last, "price"],
    "stock": [F.asc_nulls_last, "stock"], "-stock": [F.desc_nulls_last, "stock"],
    "brand": [F.asc_nulls_last, "brand"],
}


def search_items(items: DataFrame, categories: DataFrame | None = None, keyword: str | None = None,
                 category_id=None, brand: str | None = None, status: int | None = None, on_shelf: bool = False,
                 sort: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    if keyword:
        items = items.filter(F.col("item_name").rlike(f"(?i){keyword}") | F.col("item_id").cast("string").rlike(f"(?i){keyword}"))
    if category_id is not None:
        items = items.filter(F.col("category_id") == category_id)
    if brand:
        items = items.filter(F.col("brand").rlike(f"(?i){brand}"))
    if status is not None:
        items = items.filter(F.col("status") == status)
    if on_shelf:
        items = items.filter(F.col("status") == 1)
    if categories is not None:
        items = items.join(categories.select("category_id", "category_name"), "category_id", "left")
    order = ["item_id"]
    if sort:
        direction, column = SORTS[sort]
        order = [direction(column), "item_id"]
    return _page(items, order, limit, offset)


def recent_behaviors(behaviors: DataFrame, n: int = 20) -> DataFrame:
    """The latest ``n`` behaviours of every user and how many there are in all.

    The ranking is limited before its shuffle, so a hot user sends ``n`` rows per task.
    """
    order = Window.partitionBy("user_id").orderBy(F.desc("event_time"), F.desc("behavior_id"))
    latest = behaviors.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    totals = behaviors.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return latest.join(totals, "user_id")


def order_history(orders: DataFrame, order_items: DataFrame, items: DataFrame) -> DataFrame:
    """Order lines with item names and the user's paid totals, one row per line."""
    paid = paid_orders(orders).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("paid_orders"), cents(F.sum("total_amount")).alias("paid_gmv"))
    lines = order_items.join(items.select("item_id", "item_name"), "item_id", "left")
    return (
        orders.join(lines, "order_id", "left").join(paid, "user_id", "left")
        .fillna(0, subset=["paid_orders", "paid_gmv"])
    )


def nested_history(history: DataFrame) -> DataFrame:
    """One row per order with its lines as an array, for reading single orders."""
    line = F.struct("item_id", "item_name", "quantity", "unit_price", "amount")
    head = ["user_id", "order_id", "order_time", "total_amount", "status", "paid_orders", "paid_gmv"]
    return history.groupBy(*head).agg(F.array_sort(F.collect_list(F.when(F.col("item_id").isNotNull(), line))).alias("lines"))


def kpi_overview(users: DataFrame, behaviors: DataFrame, orders: DataFrame) -> DataFrame:
    """Headline figures as one row."""
    gmv = gmv_summary(orders, behaviors).select("gmv_total", "order_count", "aov", "arpu", "paid_rate")
    latest = latest_active_users(behaviors).agg(*[
        F.max(F.when(F.col("grain") == g, F.col("value"))).alias(g) for g in ("dau", "wau", "mau")])
    row = user_scale(users, behaviors)
    row = row.withColumn("g", gmv.select(F.struct(*gmv.columns).alias("r")).scalar())
    row = row.withColumn("l", latest.select(F.struct(*latest.columns).alias("r")).scalar())
    return row.select("total_users", "active_users", "buying_users", "pay_rate", "g.*", "l.*")


def item_details(items: DataFrame, behaviors: DataFrame, order_items: DataFrame, orders: DataFrame) -> DataFrame:
    stats = item_profile(items, behaviors, order_items, orders).select(
        "item_id", "behavior", "sales", "lifecycle_stage", "price_band", "heat_score")
    return items.join(stats, "item_id", "left")


def profile_with_predictions(profiles: DataFrame, purchase: DataFrame, churn: DataFrame) -> DataFrame:
    p = purchase.select("user_id", "purchase_probability")
    c = churn.select("user_id", "churn_probability", "risk_level")
    return profiles.join(p, "user_id", "left").join(c, "user_id", "left")


def lists_side_by_side(lists: DataFrame, algorithms) -> DataFrame:
    """One row per user and rank with the item of every algorithm."""
    return lists.groupBy("user_id", "rank").agg(*[
        F.max(F.when(F.col("algorithm") == a, F.col("item_id"))).alias(a) for a in algorithms])


def metric_summary(model_metrics: dict[str, DataFrame], ranking: DataFrame) -> DataFrame:
    """Test metrics of every task and the ranking comparison as (task, name, metric, value)."""
    def tall(df: DataFrame, task: str, name: str, metrics) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return df.select(F.lit(task).alias("task"), F.col(name).alias("name"), F.inline(rows))
    out = tall(ranking, "recommendation", "algorithm", ("precision", "recall", "f1", "hit_rate", "ndcg", "coverage"))
    for task, df in model_metrics.items():
        out = out.unionByName(tall(df.filter("split = 'test'"), task, "model",
                                   ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")))
    return out
