"""Cohorts and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_div
from ..settings import RETENTION_OFFSETS


def _user_days(behaviors: DataFrame) -> DataFrame:
    return behaviors.select("user_id", "event_date").filter(F.col("event_date").isNotNull()).distinct()


def cohort_analysis(behaviors: DataFrame, users: DataFrame | None = None,
                    base: str = "first_behavior", offsets=RETENTION_OFFSETS) -> DataFrame:
    """Size and return counts per cohort day.

    Each user is reduced to a few flags first, so the cohort level needs no distinct counts.
    """
    days = _user_days(behaviors)
    if base == "register":
        if users is None:
            raise ValueError("base='register' needs the users table")
        start = (
            users.filter(F.col("register_time").isNotNull())
            .groupBy("user_id").agg(F.to_date(F.min("register_time")).alias("cohort_date"))
        )
        joined = start.join(days, "user_id", "left")
    elif base == "first_behavior":
        start = days.groupBy("user_id").agg(F.min("event_date").alias("cohort_date"))
        joined = days.join(start, "user_id")
    else:
        raise ValueError(f"unknown cohort base {base}")

    age = F.datediff("event_date", "cohort_date")
    flags = joined.groupBy("user_id", "cohort_date").agg(
        *[F.coalesce(F.max((age == d).cast("int")), F.lit(0)).alias(f"day_{d}") for d in offsets])
    cohorts = flags.groupBy("cohort_date").agg(
        F.count(F.lit(1)).alias("day_0"), *[F.sum(f"day_{d}").alias(f"day_{d}") for d in offsets])
    return cohorts.select(
        "cohort_date", F.col("day_0").alias("size"), "day_0", *[f"day_{d}" for d in offsets],
        *[safe_div(f"day_{d}", "day_0").alias(f"rate_day_{d}") for d in offsets])


def _unpivot(df: DataFrame, offsets) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(d).alias("offset"), F.col(f"day_{d}").alias("retained")) for d in offsets])
    return df.select(*[c for c in ("cohort_date", "size") if c in df.columns], F.inline(rows))


def retention_overall(cohorts: DataFrame, offsets=RETENTION_OFFSETS) -> DataFrame:
    """Recent cohorts stay in the base even where the offset lies after the data ends."""
    return (
        _unpivot(cohorts, offsets).groupBy("offset")
        .agg(F.sum("retained").alias("retained"), F.sum("size").alias("base"))
        .select("offset", "retained", "base", safe_div("retained", "base").alias("rate"))
    )


def cohort_aggregate(cohorts: DataFrame, offsets=RETENTION_OFFSETS) -> DataFrame:
    """Size-weighted rates over all cohorts, one row."""
    total = F.sum("day_0")
    return cohorts.agg(
        F.count(F.lit(1)).alias("total_cohorts"), total.alias("total_users"),
        *[safe_div(F.sum(f"day_{d}"), total).alias(f"day_{d}") for d in offsets])


def retention_by_cohort(cohorts: DataFrame, offsets=RETENTION_OFFSETS) -> DataFrame:
    return _unpivot(cohorts, offsets).select(
        "cohort_date", "size", "offset", safe_div("retained", "size").alias("rate"))
