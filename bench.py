"""Time the headline queries once each: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "D01_user_scale", "D04_dau", "D14_gmv_trend_orders", "D16_item_ranking_orders", "D17_category_ranking_orders",
    "D18_brand_ranking_orders", "D19_conversion_funnel", "D20_cohort_first_behavior", "D23_rfm_orders",
    "E01_user_lifecycle_orders", "E03_top_paths", "E05_item_lifecycle_orders", "E08_price_bins_orders", "E10_channel_orders",
    "E12_item_rules", "E13_category_rules", "E17_user_profile_orders", "E18_item_profile_orders", "B13_reconcile_orders",
    "B14_quality_report", "F01_user_features", "F02_item_features", "G04_purchase_dataset", "H04_popular_top_k",
    "H08_itemcf_top_k", "H10_usercf_top_k", "I05_evaluate_popular", "K01_stream_page_views",
)


def main() -> None:
    from stallwise.catalog import ENTRIES
    from stallwise.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": os.path.abspath(os.environ.get("BENCH_SCRATCH", "spark-warehouse/_scratch"))})
    spark.sparkContext.setLogLevel("ERROR")
    ENTRIES["A07_row_counts"].run(spark, sf_dir).collect()  # start-up cost is not a query
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        ENTRIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
