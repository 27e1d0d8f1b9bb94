"""Build and write the feature tables, with a dictionary of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import item_features, observation_window, user_features, user_item_features
from ..settings import FeatureSettings
from ..sources.tables import run_record, table_records, write_json, write_measured

KEYS = {"user_features": ("user_id",), "item_features": ("item_id",), "user_item_features": ("user_id", "item_id")}
_ATTRIBUTES = {
    "age", "gender_m", "gender_f", "register_days", "is_new_in_window", "item_name", "category_id", "brand", "price",
    "stock", "status", "days_listed",
}
_SALES = {
    "paid_order_count", "paid_gmv", "avg_order_amount", "max_order_amount", "purchased_items", "purchased_categories",
    "purchase_days", "has_purchase", "units_sold", "gmv", "n_paid_orders", "n_buying_users",
}


def _group(table: str, name: str) -> str:
    if name in KEYS[table]:
        return "key"
    if name in _ATTRIBUTES:
        return "attribute"
    return "sales" if name in _SALES else "behavior"


def feature_dictionary(tables: dict[str, DataFrame], days: int = 30) -> DataFrame:
    """One row per feature column, read off the schemas and counted on the data."""
    parts = []
    for table, df in tables.items():
        fields = [f for f in df.schema.fields if f.name in df.columns]
        filled = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(f.name).alias(f.name) for f in fields])
        rows = F.array(*[F.struct(
            F.lit(table).alias("table_name"), F.lit(i + 1).alias("position"), F.lit(f.name).alias("field"),
            F.lit(_group(table, f.name)).alias("group"), F.lit(f.dataType.simpleString()).alias("type"),
            F.lit("static" if _group(table, f.name) in ("key", "attribute") else f"last {days} days").alias("window"),
            F.col("rows").alias("rows"), F.col(f.name).alias("filled")) for i, f in enumerate(fields)])
        parts.append(filled.select(F.inline(rows)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_features(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str,
                 cfg: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Write the three tables as Parquet, the dictionary as JSON, and a run record."""
    users, items = tables["users"], tables["items"]
    behaviors, orders, lines = tables["user_behaviors"], tables["orders"], tables["order_items"]
    built = {
        "user_features": user_features(users, behaviors, orders, lines, items, cfg),
        "item_features": item_features(items, behaviors, lines, orders, cfg),
        "user_item_features": user_item_features(behaviors, items, cfg),
    }
    measured = {name: write_measured(df, f"{out_dir}/{name}") for name, df in built.items()}
    write_json(table_records(spark, measured), f"{out_dir}/table_records")
    written = {name: spark.read.parquet(f"{out_dir}/{name}") for name in built}
    write_json(feature_dictionary(written, cfg.observation_days), f"{out_dir}/feature_dictionary")
    start, end = observation_window(behaviors, cfg.observation_days, cfg.obs_end)
    window = spark.range(1).select(start.alias("s"), end.alias("e")).first()
    record = run_record(spark, job="features", rows=sum(m["rows"] for m in measured.values()), obs_start=window["s"], obs_end=window["e"],
                        observation_days=cfg.observation_days, session_gap_minutes=cfg.session_gap_minutes, weights=cfg.weights)
    write_json(record, f"{out_dir}/run_record")
    return record
