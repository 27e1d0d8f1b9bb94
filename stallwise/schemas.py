"""Logical tables: one schema each, whose columns carry their rules as metadata."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_KINDS = {"text": T.StringType(), "real": T.DoubleType(), "whole": T.IntegerType(), "time": T.TimestampType(), "day": T.DateType()}


def column(name: str, kind: str = "text", **rules: Any) -> T.StructField:
    """A nullable column.  Rules: ``key``, ``required``, ``allowed`` (values), ``low`` and ``high`` (bounds that still
    pass), ``over`` (a bound that does not), ``points_at`` ("table.column"), ``follows`` (the time it is rebuilt from).
    """
    return T.StructField(name, _KINDS[kind], True, rules)


# They must equal the data contract of the behaviour log and shop tables (names, allowed values, bounds).
BEHAVIOR_TYPES = ("pv", "click", "collect", "cart", "buy")
DEVICE_TYPES = ("mobile", "pc", "tablet")
CHANNELS = ("organic", "search", "ads", "campaign", "recommendation")
ORDER_STATUSES = ("paid", "cancelled", "refunded")

TABLES: dict[str, T.StructType] = {
    "categories": T.StructType([
        column("category_id", key=True, required=True),
        column("category_name", required=True),
        column("parent_id", points_at="categories.category_id"),
    ]),
    "users": T.StructType([
        column("user_id", key=True, required=True),
        column("age", "whole", low=18.0, high=60.0),
        column("gender", allowed=["M", "F"]),
        column("city"),
        column("register_time", "time", required=True),
        column("created_at", "time", required=True),
        column("updated_at", "time", required=True),
    ]),
    "items": T.StructType([
        column("item_id", key=True, required=True),
        column("item_name", required=True),
        column("category_id", required=True, points_at="categories.category_id"),
        column("brand"),
        column("price", "real", required=True, low=0.0),
        column("stock", "whole", required=True, low=0.0),
        column("status", "whole", required=True, allowed=["0", "1"]),
        column("created_at", "time", required=True),
    ]),
    "user_behaviors": T.StructType([
        column("behavior_id", key=True, required=True),
        column("user_id", required=True, points_at="users.user_id"),
        column("item_id", required=True, points_at="items.item_id"),
        column("behavior_type", required=True, allowed=list(BEHAVIOR_TYPES)),
        column("event_time", "time", required=True),
        column("event_date", "day", required=True, follows="event_time"),
        column("event_hour", "whole", required=True, low=0.0, high=23.0, follows="event_time"),
        column("device_type", required=True, allowed=list(DEVICE_TYPES)),
        column("channel", required=True, allowed=list(CHANNELS)),
    ]),
    "orders": T.StructType([
        column("order_id", key=True, required=True),
        column("user_id", required=True, points_at="users.user_id"),
        column("order_time", "time", required=True),
        column("total_amount", "real", required=True, low=0.0),
        column("status", required=True, allowed=list(ORDER_STATUSES)),
        column("payment_method"),
    ]),
    "order_items": T.StructType([
        column("order_id", required=True, points_at="orders.order_id"),
        column("item_id", required=True, points_at="items.item_id"),
        column("quantity", "whole", required=True, over=0.0),
        column("unit_price", "real", required=True, low=0.0),
        column("amount", "real", required=True, low=0.0),
    ]),
}

# References only ever point to a table that stands earlier in this order.
LOAD_ORDER = tuple(TABLES)


def columns_of(table: str) -> list[str]:
    return TABLES[table].fieldNames()


def ruled(table: str, rule: str) -> dict[str, Any]:
    """Columns of a table that carry ``rule``, with its value."""
    return {f.name: f.metadata[rule] for f in TABLES[table].fields if rule in f.metadata}


def key_of(table: str) -> str | None:
    return next(iter(ruled(table, "key")), None)


def references(table: str) -> dict[str, tuple[str, str]]:
    """Column -> (table, column) it points at."""
    return {name: tuple(target.split(".")) for name, target in ruled(table, "points_at").items()}


def times_of(table: str) -> list[str]:
    return [f.name for f in TABLES[table].fields if isinstance(f.dataType, T.TimestampType)]


def require_columns(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"table {table}: missing columns {missing}")
    return df
