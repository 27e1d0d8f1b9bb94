"""Feature windows, labels and leakage guards."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import by
from stallwise.operators.features import item_features, user_features, user_item_features, windowed_user_features
from stallwise.operators.snapshots import (buyers_after, churn_dataset, purchase_dataset, snapshot_calendar,
                                           time_split)
from stallwise.plans.features import feature_dictionary
from stallwise.settings import FeatureSettings, SnapshotSettings

CFG = FeatureSettings(obs_end="2026-08-31")


@pytest.fixture(scope="module")
def shop(make):
    users = make.users([("U1", 30, "M", "2026-01-01T00:00:00"), ("U2", 30, "F", "2026-01-01T00:00:00"),
                        ("U3", 30, "M", "2026-08-20T00:00:00"), ("U4", 30, "F", "2026-01-01T00:00:00")])
    items = make.items([("I1", "n", "C1", "b", 100, 1, "2026-01-01T00:00:00")])
    behaviors = make.behaviors([
        ("B1", "U1", "I1", "pv", "2026-07-01T10:00:00"), ("B2", "U1", "I1", "pv", "2026-08-05T10:00:00"),
        ("B3", "U1", "I1", "click", "2026-08-05T10:05:00"), ("B4", "U1", "I1", "buy", "2026-08-20T10:00:00"),
        ("B5", "U1", "I1", "pv", "2026-09-01T10:00:00"), ("B6", "U2", "I1", "pv", "2026-08-10T10:00:00"),
        ("B7", "U2", "I1", "pv", "2026-08-11T10:00:00"), ("B8", "U3", "I1", "buy", "2026-08-25T10:00:00")])
    orders = make.orders([("O1", "U1", "2026-08-21T10:00:00", 100, "paid"), ("O2", "U2", "2026-08-09T10:00:00", 50, "paid"),
                          ("O3", "U2", "2026-08-28T10:00:00", 999, "cancelled"), ("O4", "U1", "2026-07-01T10:00:00", 500, "paid"),
                          ("O5", "U3", "2026-08-30T10:00:00", 200, "paid")])
    lines = make.lines([("O1", "I1", 1, 100), ("O2", "I1", 1, 50), ("O3", "I1", 1, 999), ("O4", "I1", 1, 500), ("O5", "I1", 2, 200)])
    return users, behaviors, orders, lines, items


def test_user_features(shop):
    table = user_features(*shop, CFG)
    assert len(table.columns) == 39
    rows = by(table, "user_id")
    u1, u3, u4 = rows["U1"], rows["U3"], rows["U4"]
    assert (u1["total_behaviors"], u1["n_active_days"], u1["recency_days"], u1["first_activity_offset_days"]) == (3, 2, 11, 3)
    assert (u1["n_sessions"], u1["paid_order_count"], u1["paid_gmv"], u1["behaviors_per_session"]) == (2, 1, 100.0, 1.5)
    assert (u4["recency_days"], u4["top_channel"], u4["total_behaviors"]) == (30, "", 0)
    assert (u3["is_new_in_window"], u3["paid_gmv"], u3["buy_rate"]) == (1, 200.0, 0.0)


def test_item_and_pair_features(shop):
    users, behaviors, orders, lines, items = shop
    row = item_features(items, behaviors, lines, orders, CFG).first()
    assert (row["n_pv"], row["n_click"], row["n_buy"], row["total_behaviors"], row["n_unique_users"]) == (3, 1, 2, 6, 3)
    assert (row["gmv"], row["units_sold"], row["n_paid_orders"]) == (350.0, 4, 3)
    assert by(user_item_features(behaviors, items, CFG), "user_id")["U1"]["weighted_score"] == 8.0
    heavy = FeatureSettings(obs_end="2026-08-31", weights={"pv": 1, "click": 2, "collect": 4, "cart": 6, "buy": 10})
    assert by(user_item_features(behaviors, items, heavy), "user_id")["U1"]["weighted_score"] == 13.0


def test_order_on_the_last_day_belongs_to_the_label(make, shop):
    """After midnight of the last day an order is no feature any more, but it is a label."""
    users, behaviors, _, lines, items = shop
    orders = make.orders([("O1", "U1", "2026-08-31T00:00:00", 10, "paid"), ("O2", "U2", "2026-08-31T09:00:00", 20, "paid")])
    rows = by(user_features(users, behaviors, orders, lines, items, CFG), "user_id")
    assert rows["U1"]["paid_order_count"] == 1 and rows["U2"]["paid_order_count"] == 0
    ends = [date(2026, 8, 31)]
    assert {r["user_id"] for r in buyers_after(orders, ends, 7).collect()} == {"U2"}


def test_session_cut_by_the_window_start_counts(make, shop):
    users, _, orders, lines, items = shop
    b = make.behaviors([("B1", "U1", "I1", "pv", "2026-08-01T23:50:00"), ("B2", "U1", "I1", "pv", "2026-08-02T00:05:00")])
    ends = [date(2026, 8, 31), date(2026, 8, 30)]
    rows = by(windowed_user_features(users, b, orders, lines, items, ends, 30), "user_id", "obs_end")
    got = {str(k[1]): (r["total_behaviors"], r["n_sessions"]) for k, r in rows.items() if k[0] == "U1"}
    assert got == {"2026-08-31": (1, 1), "2026-08-30": (2, 1)}


def test_events_without_a_time_count_but_open_no_session(make, shop):
    users, _, orders, lines, items = shop
    b = make.behaviors([("B1", "U1", "I1", "pv", "2026-08-20T10:00:00"), ("B2", "U1", "I1", "buy", "2026-08-21T10:00:00")])
    b = b.withColumn("event_time", F.when(F.col("behavior_id") == "B1", F.col("event_time")))
    row = by(windowed_user_features(users, b, orders, lines, items, [date(2026, 8, 31)], 30), "user_id")["U1"]
    assert (row["total_behaviors"], row["n_buy"], row["n_active_days"], row["n_sessions"]) == (2, 1, 2, 1)


def test_windows_read_only_their_days(spark, make, shop, tmp_path):
    users, _, orders, lines, items = shop
    b = make.behaviors([("B1", "U1", "I1", "pv", "2026-01-20T10:00:00"), ("B2", "U1", "I1", "buy", "2026-08-21T10:00:00")])
    b.write.partitionBy("event_date").parquet(str(tmp_path / "b"))
    table = windowed_user_features(users, spark.read.parquet(str(tmp_path / "b")), orders, lines, items, [date(2026, 8, 31)], 30)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "2026-08-02" in plan
    assert by(table, "user_id")["U1"]["total_behaviors"] == 1


def test_dictionary_covers_every_column(shop):
    table = user_features(*shop, CFG)
    fields = [r["field"] for r in feature_dictionary({"user_features": table}).collect()]
    assert sorted(fields) == sorted(table.columns)


def test_labels(make, shop):
    users, behaviors, orders, lines, items = shop
    later = orders.unionByName(make.orders([("O9", "U2", "2026-09-05T10:00:00", 5, "paid"), ("O8", "U4", "2026-09-06T10:00:00", 5, "cancelled")]))
    cfg = SnapshotSettings(ends=("2026-08-31",))
    labels = {r["user_id"]: r["label"] for r in purchase_dataset(users, behaviors, later, lines, items, cfg).collect()}
    assert labels == {"U1": 0, "U2": 1, "U3": 0, "U4": 0}
    churn = SnapshotSettings(ends=("2026-08-31",), label_days=30)
    labels = {r["user_id"]: r["label"] for r in churn_dataset(users, behaviors, later, lines, items, churn).collect()}
    assert labels == {"U1": 1, "U2": 0, "U3": 1}


def test_calendar(make):
    b = make.behaviors([("B1", "U", "I", "pv", "2026-06-02T00:00:00"), ("B2", "U", "I", "pv", "2026-08-31T00:00:00")])
    days = [str(r[0]) for r in snapshot_calendar(b).orderBy("obs_end").collect()]
    assert days[0] == "2026-07-01" and days[-1] <= "2026-08-24" and len(days) == 8
    short = b.filter("behavior_id = 'B1'")
    with pytest.raises(Exception, match="too short"):
        snapshot_calendar(short).collect()


def test_split_keeps_the_latest_for_the_test(spark):
    df = spark.range(50).select(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("obs_end"))
    ends = {s: sorted({str(r["obs_end"])[-2:] for r in time_split(df).filter(f"split = '{s}'").collect()}) for s in ("train", "val", "test")}
    assert ends == {"train": ["01", "02", "03", "04", "05", "06"], "val": ["07", "08"], "test": ["09", "10"]}
