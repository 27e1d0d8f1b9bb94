"""Clean all tables in reference order and report on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.cleaning import (clean_rows, event_time_range, examine, quality_report, quality_summary,
                                  reconcile_orders)
from ..schemas import LOAD_ORDER
from ..session import cut_lineage
from ..sources.tables import read_raw_csv, run_record, write_json, write_table


@dataclass(frozen=True)
class Cleaned:
    tables: dict[str, DataFrame]
    examined: dict[str, DataFrame]

    def report(self) -> DataFrame:
        return quality_report(self.examined)


def clean_tables(raw: dict[str, DataFrame], data_end: str | None = None,
                 row_order: list[str] | None = None) -> Cleaned:
    """Each table is examined once and written to the scratch folder; clean rows, references and report read it there."""
    tables: dict[str, DataFrame] = {}
    examined: dict[str, DataFrame] = {}
    for name in LOAD_ORDER:
        if name not in raw:
            continue
        examined[name] = cut_lineage(examine(raw[name], name, tables, data_end, row_order))
        tables[name] = clean_rows(examined[name], name)
    if "orders" in tables and "order_items" in tables:
        tables["orders"] = reconcile_orders(tables["orders"], tables["order_items"]).drop("corrected")
    return Cleaned(tables, examined)


def run_cleaning(spark: SparkSession, raw_dir: str, out_dir: str, data_end: str | None = None) -> DataFrame:
    """CSV in, partitioned Parquet and JSON report out; returns the run record.

    Each table is written before the next one reads it back as a reference, so no plan is
    computed twice and a lost executor costs one table at most.
    """
    raw = {n: read_raw_csv(spark, f"{raw_dir}/{n}.csv", n) for n in LOAD_ORDER}
    written: dict[str, DataFrame] = {}
    reports = []
    for name in LOAD_ORDER:
        staged = f"{out_dir}/_examined/{name}"
        examine(raw[name], name, written, data_end, ["_row"]).write.mode("overwrite").parquet(staged)
        examined = spark.read.parquet(staged)
        reports.append((name, examined))
        clean = clean_rows(examined, name)
        if name != "orders":
            write_table(clean, f"{out_dir}/{name}", "event_date" if name == "user_behaviors" else None)
            written[name] = spark.read.parquet(f"{out_dir}/{name}")
        else:
            written[name] = clean
    write_table(reconcile_orders(written["orders"], written["order_items"]).drop("corrected"), f"{out_dir}/orders")
    report = quality_report(dict(reports))
    write_json(report, f"{out_dir}/quality_report")
    span = event_time_range(written["user_behaviors"]).first()
    total = quality_summary(spark.read.json(f"{out_dir}/quality_report")).first()
    record = run_record(spark, job="cleaning", raw_dir=raw_dir, out_dir=out_dir, data_end=data_end,
                        first_time=span["first_time"], last_time=span["last_time"],
                        total_rows=total["total_rows"], final_rows=total["final_rows"])
    write_json(record, f"{out_dir}/run_record")
    return record
