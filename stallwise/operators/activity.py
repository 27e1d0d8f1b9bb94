"""Who is active, when, and how far down the funnel they get."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grids import axes, dense
from ..functions.scalar import safe_div, scalar_row, type_counts
from ..schemas import BEHAVIOR_TYPES, DEVICE_TYPES
from ..settings import UNKNOWN_LABEL


def pair_counts(behaviors: DataFrame) -> DataFrame:
    """Counts per (user, item).

    Most item, category and brand figures start here: the event log is reduced map-side
    before anything is joined, so a hot item is at most one row per user afterwards.
    """
    return behaviors.groupBy("user_id", "item_id").agg(
        *type_counts(), F.count(F.lit(1)).alias("total")
    )


def user_scale(users: DataFrame, behaviors: DataFrame) -> DataFrame:
    per_user = behaviors.groupBy("user_id").agg(F.max(F.col("behavior_type") == "buy").alias("buyer"))
    activity = scalar_row(
        per_user.filter(F.col("user_id").isNotNull()),
        active=F.count(F.lit(1)), buying=F.count_if("buyer"),
    )
    return (
        users.agg(F.count(F.lit(1)).alias("total_users"),
                  F.countDistinct("user_id").alias("new_users"))
        .withColumn("a", activity)
        .select("total_users", "new_users", F.col("a.active").alias("active_users"),
                F.col("a.buying").alias("buying_users"),
                safe_div("a.buying", "a.active").alias("pay_rate"))
    )


def register_trend(users: DataFrame) -> DataFrame:
    return (
        users.filter(F.col("register_time").isNotNull())
        .groupBy(F.to_date("register_time").alias("date"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts per value with a label for nulls; a column of nulls only gives no rows."""
    counts = df.groupBy(F.col(column).cast("string").alias("raw")).agg(F.count(F.lit(1)).alias("count"))
    known = scalar_row(counts, n=F.count("raw"))
    return (
        counts.filter(known["n"] > 0)
        .select(F.coalesce("raw", F.lit(UNKNOWN_LABEL)).alias("label"), "count")
        .groupBy("label").agg(F.sum("count").alias("count"))
    )


def active_users(behaviors: DataFrame) -> DataFrame:
    """DAU, WAU (weeks start on Monday) and MAU in one tidy table."""
    days = behaviors.select("user_id", "event_date").filter(F.col("event_date").isNotNull()).distinct()

    def grain(name: str, bucket, label) -> DataFrame:
        return (
            days.select("user_id", bucket.alias("bucket")).distinct()
            .filter(F.col("user_id").isNotNull())
            .groupBy("bucket").agg(F.count(F.lit(1)).alias("value"))
            .select(F.lit(name).alias("grain"), label.alias("bucket"), "value")
        )

    day_label = F.date_format("bucket", "yyyy-MM-dd")
    return (
        grain("dau", F.col("event_date"), day_label)
        .unionByName(grain("wau", F.trunc("event_date", "week"), day_label))
        .unionByName(grain("mau", F.trunc("event_date", "month"), F.date_format("bucket", "yyyy-MM")))
    )


def latest_active_users(behaviors: DataFrame) -> DataFrame:
    return active_users(behaviors).groupBy("grain").agg(
        F.max("bucket").alias("bucket"), F.max_by("value", "bucket").alias("value")
    )


def behavior_summary(behaviors: DataFrame) -> DataFrame:
    counts = behaviors.agg(F.count(F.lit(1)).alias("total"), *type_counts())
    rates = [safe_div(t, "pv").alias(f"{t}_rate") for t in BEHAVIOR_TYPES[1:]]
    return counts.select("*", *rates)


def behavior_trend(behaviors: DataFrame) -> DataFrame:
    return (
        behaviors.filter(F.col("event_date").isNotNull())
        .groupBy(F.col("event_date").alias("date")).agg(*type_counts())
    )


def _timed(behaviors: DataFrame) -> DataFrame:
    return behaviors.filter(F.col("event_hour").isNotNull() & F.col("event_date").isNotNull())


def activity_by_hour(behaviors: DataFrame) -> DataFrame:
    counts = _timed(behaviors).groupBy(F.col("event_hour").cast("int").alias("hour")).agg(
        *type_counts(types=("pv", "buy")), F.count(F.lit(1)).alias("total")
    )
    return dense(counts, axes(behaviors.sparkSession, hour=range(24)), ["hour"], ["pv", "buy", "total"])


def activity_by_weekday(behaviors: DataFrame) -> DataFrame:
    """Monday is 0."""
    counts = _timed(behaviors).groupBy(F.weekday("event_date").alias("weekday")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return dense(counts, axes(behaviors.sparkSession, weekday=range(7)), ["weekday"], ["count"])


def activity_by_device_hour(behaviors: DataFrame) -> DataFrame:
    counts = _timed(behaviors).groupBy(
        F.col("device_type").alias("device"), F.col("event_hour").cast("int").alias("hour")
    ).agg(F.count(F.lit(1)).alias("count"))
    axis = axes(behaviors.sparkSession, device=DEVICE_TYPES, hour=range(24))
    return dense(counts, axis, ["device", "hour"], ["count"])


def conversion_funnel(behaviors: DataFrame) -> DataFrame:
    """One scan, one aggregate; the stages are unpivoted from that single row."""
    counts = behaviors.agg(*type_counts())
    stages = F.array(*[
        F.struct(
            F.lit(i + 1).alias("step"), F.lit(stage).alias("stage"), F.col(stage).alias("count"),
            (F.lit(1.0) if i == 0 else safe_div(stage, BEHAVIOR_TYPES[i - 1])).alias("step_conversion_rate"),
            safe_div(stage, "pv").alias("overall_conversion_rate"),
        )
        for i, stage in enumerate(BEHAVIOR_TYPES)
    ])
    return counts.select(F.inline(stages))


