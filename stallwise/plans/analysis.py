"""Run every analysis over the clean tables and write one folder per result."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, baskets, catalogue, models, paths, profiles, retention, revenue, value
from ..sources.tables import run_record, write_json, write_measured

# Results with a row per user or item are tables; the rest are short reports.
LARGE = {"rfm_users", "lifecycle_users", "item_lifecycle", "user_profile", "item_profile", "user_segments", "register_trend"}


def analyses(tables: dict[str, DataFrame], top_n: int = 10, n_bins: int = 5) -> dict[str, DataFrame]:
    """All results by name, lazy apart from the clustering."""
    users, items, behaviors = tables["users"], tables["items"], tables["user_behaviors"]
    orders, lines = tables["orders"], tables["order_items"]
    cohorts = retention.cohort_analysis(behaviors)
    scored = value.rfm(orders)
    staged = value.user_lifecycle(users, behaviors, orders)
    item_stages = catalogue.item_lifecycle(items, behaviors, lines, orders)
    bins = catalogue.price_bins(items, behaviors, lines, orders, n_bins)
    segments = models.assign_clusters(models.segmentation_features(behaviors, orders))
    out = {
        "user_scale": activity.user_scale(users, behaviors),
        "register_trend": activity.register_trend(users),
        "gender_distribution": activity.value_distribution(users, "gender"),
        "city_distribution": activity.value_distribution(users, "city"),
        "active_users": activity.active_users(behaviors),
        "behavior_summary": activity.behavior_summary(behaviors),
        "behavior_trend": activity.behavior_trend(behaviors),
        "activity_by_hour": activity.activity_by_hour(behaviors),
        "activity_by_weekday": activity.activity_by_weekday(behaviors),
        "activity_by_device_hour": activity.activity_by_device_hour(behaviors),
        "gmv": revenue.gmv_summary(orders, behaviors),
        "gmv_trend": revenue.gmv_trend(orders, behaviors),
        "status_distribution": revenue.status_distribution(orders),
        "item_ranking": revenue.item_ranking(items, behaviors, lines, orders, top_n),
        "category_ranking": revenue.category_ranking(items, behaviors, lines, orders, top_n),
        "brand_ranking": revenue.brand_ranking(items, behaviors, lines, orders, top_n),
        "funnel": activity.conversion_funnel(behaviors),
        "cohorts": cohorts,
        "cohort_aggregate": retention.cohort_aggregate(cohorts),
        "retention": retention.retention_overall(cohorts),
        "rfm_users": scored,
        "rfm_segments": value.rfm_segments(scored),
        "rfm_scores": value.rfm_score_distribution(scored),
        "lifecycle_users": staged,
        "lifecycle": value.lifecycle_distribution(staged),
        "top_paths": paths.top_paths(behaviors, top_n=top_n),
        "path_totals": paths.path_totals(behaviors),
        "item_lifecycle": item_stages,
        "item_stages": catalogue.item_stage_distribution(item_stages),
        "price_bins": catalogue.top_price_bins(bins),
        "price_correlations": catalogue.price_correlations(bins),
        "channels": catalogue.channel_analysis(users, behaviors, orders),
        "devices": catalogue.device_analysis(behaviors, orders),
        "item_rules": baskets.item_rules(lines, orders, items),
        "category_rules": baskets.category_rules(lines, orders, items),
        "user_segments": segments,
        "segment_names": models.name_clusters(segments),
        "user_profile": profiles.user_profile(users, behaviors, orders, lines, items),
        "item_profile": profiles.item_profile(items, behaviors, lines, orders),
    }
    return {**out, "findings": profiles.findings({
        **out, "item_ranking": revenue.item_ranking(items, behaviors, lines, orders, 1), "top_paths": paths.top_paths(behaviors, top_n=1)})}


def run_analysis(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str, top_n: int = 10) -> DataFrame:
    """Write every result, and the run record, which holds the rows of every result as they were counted on their way to the files."""
    started = time.time()
    results = analyses(tables, top_n)
    measured = {name: write_measured(df, f"{out_dir}/{name}", as_json=name not in LARGE) for name, df in results.items()}
    tables_seen = F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(m["rows"]).cast("long").alias("rows")) for name, m in measured.items()])
    record = run_record(spark, job="analysis", results=len(results), rows=sum(m["rows"] for m in measured.values()), top_n=top_n,
                        elapsed_seconds=round(time.time() - started, 2)).withColumn("tables", tables_seen)
    write_json(record, f"{out_dir}/run_record")
    return record
