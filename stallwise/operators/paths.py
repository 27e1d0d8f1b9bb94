"""Behaviour paths inside sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_div
from ..functions.sequence import sessions

ARROW = "→"


def session_starts(behaviors: DataFrame, gap_minutes: int = 30) -> DataFrame:
    return sessions(
        behaviors.select("user_id", "behavior_id", "event_time", "behavior_type"), gap_minutes
    ).select("user_id", "behavior_id", "event_time", "behavior_type", "new_session", "session_start")


def collapsed_steps(behaviors: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Session rows without immediate repeats of the same behaviour."""
    rows = sessions(behaviors.select("user_id", "behavior_id", "event_time", "behavior_type"),
                    gap_minutes, carry=("behavior_type",))
    return rows.filter(F.col("new_session") | (F.col("_prev.behavior_type") != F.col("behavior_type")))


def session_paths(behaviors: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """One path per session, joined bucket by bucket and then over the buckets."""
    steps = collapsed_steps(behaviors, gap_minutes)
    pieces = steps.groupBy("user_id", "session_start", "_bucket").agg(
        F.array_sort(F.collect_list(F.struct("event_time", "behavior_id", "behavior_type"))).alias("s"),
        F.max((F.col("behavior_type") == "buy").cast("int")).alias("buy"),
    ).select("user_id", "session_start", "_bucket", "buy", F.size("s").alias("tokens"),
             F.array_join(F.transform("s", lambda x: x["behavior_type"]), ARROW).alias("piece"))
    return pieces.groupBy("user_id", "session_start").agg(
        F.array_sort(F.collect_list(F.struct("_bucket", "piece"))).alias("p"),
        F.sum("tokens").alias("tokens"), F.max("buy").alias("buy"),
    ).select("user_id", "session_start", "tokens", "buy",
             F.array_join(F.transform("p", lambda x: x["piece"]), ARROW).alias("path"))


def path_table(paths: DataFrame) -> DataFrame:
    per_user = paths.groupBy("path", "user_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("buy").alias("buy_sessions"))
    return per_user.groupBy("path").agg(
        F.sum("sessions").alias("sessions"), F.count(F.lit(1)).alias("users"),
        F.sum("buy_sessions").alias("buy_sessions"),
    ).withColumn("final_buy_rate", safe_div("buy_sessions", "sessions"))


def top_paths(behaviors: DataFrame, gap_minutes: int = 30, top_n: int = 10) -> DataFrame:
    table = path_table(session_paths(behaviors, gap_minutes))
    return table.orderBy(F.desc("sessions"), "path").limit(top_n)


def path_totals(behaviors: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Totals plus the longest path; the earliest session of the lowest user wins a tie."""
    paths = session_paths(behaviors, gap_minutes)
    table = path_table(paths)
    longest = paths.agg(
        F.sum(F.lit(1)).alias("total_sessions"), F.countDistinct("user_id").alias("total_users"),
        F.min_by(F.struct("path", "tokens"), F.struct(-F.col("tokens"), "user_id", "session_start")).alias("l"))
    distinct = table.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        longest.select("total_sessions", "total_users", distinct.alias("distinct_paths"),
                       F.col("l.tokens").alias("longest_tokens"), F.col("l.path").alias("path"))
        .join(table.select("path", F.col("users").alias("longest_users")), "path", "left")
        .withColumnRenamed("path", "longest_path")
    )
