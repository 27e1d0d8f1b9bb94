"""Panels of user features at many dates, with purchase and churn labels from the days after."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import SnapshotSettings
from .features import days_array, per_window, windowed_user_features
from .revenue import paid_orders


def snapshot_range(behaviors: DataFrame, cfg: SnapshotSettings = SnapshotSettings()) -> DataFrame:
    """First and last day whose observation and label windows both lie inside the data."""
    last = F.max("event_date")
    if cfg.latest_day:
        last = F.least(last, F.lit(cfg.latest_day).cast("date"))
    return behaviors.agg(F.date_add(F.min("event_date"), cfg.observation_days - 1).alias("earliest"),
                         F.date_sub(last, cfg.label_days).alias("latest"))


def snapshot_ends(behaviors: DataFrame, cfg: SnapshotSettings = SnapshotSettings()) -> list[date]:
    """The snapshot days: the given ones, or steps through the range.  Two dates are read to find it."""
    if cfg.ends:
        return [date.fromisoformat(d) for d in sorted(cfg.ends)]
    reach = snapshot_range(behaviors, cfg).first()
    if reach["earliest"] is None or reach["earliest"] > reach["latest"]:
        raise ValueError("the data are too short for the observation and label windows")
    step = max(cfg.step_days, 1)
    return [reach["earliest"] + timedelta(days=n) for n in range(0, (reach["latest"] - reach["earliest"]).days + 1, step)]


def snapshot_calendar(behaviors: DataFrame, cfg: SnapshotSettings = SnapshotSettings()) -> DataFrame:
    return behaviors.sparkSession.range(1).select(F.explode(days_array(snapshot_ends(behaviors, cfg))).alias("obs_end"))


def buyers_after(orders: DataFrame, ends: list[date], label_days: int) -> DataFrame:
    """(user, obs_end) with a paid order after midnight of obs_end and within the label days."""
    time = F.col("order_time")
    reach = time.between(F.lit(min(ends)).cast("timestamp_ntz"), F.lit(max(ends) + timedelta(days=label_days)).cast("timestamp_ntz"))
    hits = per_window(paid_orders(orders).filter(reach).select("user_id", "order_time"), ends, lambda e: (
        (time > e.cast("timestamp_ntz")) & (time <= F.date_add(e, label_days).cast("timestamp_ntz"))))
    return hits.select("user_id", "obs_end").distinct()


def active_after(behaviors: DataFrame, orders: DataFrame, ends: list[date], label_days: int,
                 key_types: tuple[str, ...]) -> DataFrame:
    """(user, obs_end) that stay: a key behaviour or a paid order in the label days."""
    day = F.col("event_date")
    reach = day.between(F.lit(min(ends)).cast("date"), F.lit(max(ends) + timedelta(days=label_days)).cast("date"))
    keyed = behaviors.filter(reach & F.col("behavior_type").isin(list(key_types))).select("user_id", "event_date").distinct()
    acted = per_window(keyed, ends, lambda e: (day > e) & (day <= F.date_add(e, label_days)))
    return acted.select("user_id", "obs_end").unionByName(buyers_after(orders, ends, label_days)).distinct()


def _features(users, behaviors, orders, order_items, items, ends, cfg) -> DataFrame:
    return windowed_user_features(users, behaviors, orders, order_items, items, ends,
                                  cfg.observation_days, cfg.session_gap_minutes)


def _labelled(features: DataFrame, hits: DataFrame, when_hit: int) -> DataFrame:
    flagged = features.join(hits.withColumn("_hit", F.lit(True)), ["user_id", "obs_end"], "left")
    label = F.when(F.col("_hit"), when_hit).otherwise(1 - when_hit)
    rest = [c for c in features.columns if c not in ("user_id", "obs_end")]
    return flagged.select("user_id", "obs_end", label.alias("label"), *rest)


def purchase_dataset(users: DataFrame, behaviors: DataFrame, orders: DataFrame, order_items: DataFrame,
                     items: DataFrame, cfg: SnapshotSettings = SnapshotSettings()) -> DataFrame:
    ends = snapshot_ends(behaviors, cfg)
    features = _features(users, behaviors, orders, order_items, items, ends, cfg)
    return _labelled(features, buyers_after(orders, ends, cfg.label_days), 1)


def churn_dataset(users: DataFrame, behaviors: DataFrame, orders: DataFrame, order_items: DataFrame,
                  items: DataFrame, cfg: SnapshotSettings = SnapshotSettings(label_days=30)) -> DataFrame:
    """Only users active in the window are candidates; churn is the absence of a later sign of life."""
    ends = snapshot_ends(behaviors, cfg)
    features = _features(users, behaviors, orders, order_items, items, ends, cfg).filter(F.col("total_behaviors") > 0)
    return _labelled(features, active_after(behaviors, orders, ends, cfg.label_days, cfg.key_types), 0)


def time_split(dataset: DataFrame, val_ratio: float = 0.2, test_ratio: float = 0.2, days: list[date] | None = None) -> DataFrame:
    """Adds ``split``: the latest snapshots are the test part, those before it validation.

    ``days`` are the snapshot days of the panel; without them they are read from it, a short list bounded by the calendar.
    """
    ends = days_array(sorted(days)) if days else dataset.agg(F.array_sort(F.collect_set("obs_end")).alias("e")).scalar()
    n = F.size(ends)
    n_test = F.greatest(F.lit(1), F.rint(n * test_ratio).cast("int"))
    n_val = F.greatest(F.lit(0), F.rint(n * val_ratio).cast("int"))
    enough = n - n_val - n_test >= 1
    n_train = F.when(enough, n - n_val - n_test).otherwise(1)
    n_val = F.when(enough, n_val).otherwise(0)
    position = F.array_position(ends, F.col("obs_end"))
    return dataset.withColumn("split", F.when(position <= n_train, "train").when(
        position <= n_train + n_val, "val").otherwise("test"))
