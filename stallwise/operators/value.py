"""RFM scores and user lifecycle stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grids import axes, dense, ordered_axis
from ..functions.scalar import (bin_score_high, bin_score_low, cents, elapsed_days, first_rule, rule_labels,
                                safe_div, scalar_row)
from ..settings import LifecycleSettings, NEVER_ACTIVE_DAYS, RfmSettings
from .revenue import paid_orders


def rfm(orders: DataFrame, cfg: RfmSettings = RfmSettings()) -> DataFrame:
    """One pass per buyer; recency uses every paid order, count and amount the period only."""
    paid = paid_orders(orders).filter(F.col("order_time").isNotNull())
    if cfg.as_of:
        as_of = F.lit(cfg.as_of).cast("timestamp_ntz")
    else:
        as_of = scalar_row(paid, t=F.max("order_time"))["t"]
    in_period = F.col("order_time") >= as_of - F.make_dt_interval(F.lit(cfg.period_days))
    per_user = paid.groupBy("user_id").agg(
        F.max("order_time").alias("last_time"),
        F.count_if(in_period).alias("purchase_count"),
        F.coalesce(F.sum(F.when(in_period, F.col("total_amount"))), F.lit(0.0)).alias("amount"))
    scored = per_user.select(
        "user_id", elapsed_days(as_of, "last_time").alias("recency_days"), "purchase_count", "amount",
    ).select(
        "*", bin_score_low("recency_days", cfg.r_bins).alias("r_score"),
        bin_score_high("purchase_count", cfg.f_bins).alias("f_score"),
        bin_score_high("amount", cfg.m_bins).alias("m_score"))
    scores = {"r": F.col("r_score"), "f": F.col("f_score"), "m": F.col("m_score")}
    return scored.select(
        "user_id", "recency_days", "purchase_count", F.round("amount", 2).alias("total_amount"),
        "r_score", "f_score", "m_score",
        (F.col("r_score") * 100 + F.col("f_score") * 10 + F.col("m_score")).alias("rfm_score"),
        (F.col("r_score") + F.col("f_score") + F.col("m_score")).alias("rfm_total"),
        first_rule(cfg.rules, scores).alias("segment"))


def rfm_segments(scored: DataFrame) -> DataFrame:
    total = scalar_row(scored, n=F.count(F.lit(1)))["n"]
    return (
        scored.groupBy("segment")
        .agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("total_amount"), 2).alias("gmv"))
        .select("segment", "count", "gmv", safe_div("count", total).alias("ratio"))
    )


def rfm_score_distribution(scored: DataFrame) -> DataFrame:
    names = ("r_score", "f_score", "m_score")
    rows = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("score")) for n in names])
    counts = (
        scored.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).select(F.inline(rows), "n")
        .groupBy("dimension", "score").agg(F.sum("n").alias("count"))
    )
    axis = axes(scored.sparkSession, dimension=names, score=range(1, 6))
    return dense(counts, axis, ["dimension", "score"], ["count"])


def user_lifecycle(users: DataFrame, behaviors: DataFrame, orders: DataFrame,
                   cfg: LifecycleSettings = LifecycleSettings()) -> DataFrame:
    last = behaviors.filter(F.col("event_date").isNotNull()).groupBy("user_id").agg(
        F.max("event_date").alias("last_active"))
    as_of = F.lit(cfg.as_of).cast("date") if cfg.as_of else scalar_row(last, d=F.max("last_active"))["d"]
    bought = paid_orders(orders).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("purchase_count"), F.sum("total_amount").alias("total_amount"))
    base = (
        users.select("user_id", "register_time")
        .join(last, "user_id", "left").join(bought, "user_id", "left")
        .fillna(0, subset=["purchase_count", "total_amount"])
        .select(
            "user_id", F.datediff(as_of, F.to_date("register_time")).alias("register_days"),
            F.coalesce(F.datediff(as_of, "last_active"), F.lit(NEVER_ACTIVE_DAYS)).alias("recency_days"),
            "purchase_count", "total_amount")
    )
    return base.select(
        "user_id", "register_days", "recency_days", "purchase_count",
        F.round("total_amount", 2).alias("total_amount"), first_rule(cfg.rules).alias("stage"))


def lifecycle_distribution(staged: DataFrame, cfg: LifecycleSettings = LifecycleSettings()) -> DataFrame:
    total = scalar_row(staged, n=F.count(F.lit(1)))["n"]
    counts = staged.groupBy("stage").agg(
        F.count(F.lit(1)).alias("count"), cents(F.sum("total_amount")).alias("amount"))
    axis = ordered_axis(staged.sparkSession, "stage", rule_labels(cfg.rules))
    return dense(counts, axis, ["stage"], ["count", "amount"]).select(
        "stage", "count", safe_div("count", total).alias("ratio"), F.col("amount").alias("gmv"),
        safe_div("amount", "count").alias("avg_amount"))
