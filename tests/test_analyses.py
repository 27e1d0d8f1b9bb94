"""Basic and deep analyses on hand-made tables with known answers."""

import pytest
from pyspark.sql import functions as F

from conftest import by
from stallwise.operators import activity, baskets, catalogue, paths, retention, revenue, value
from stallwise.settings import BasketSettings, ItemLifeSettings, RfmSettings

TYPES = "pv pv pv click click click collect cart cart buy pv pv".split()
USERS = ["U1"] * 5 + ["U2"] * 4 + ["U3", "U1", "U3"]
DAYS = ["03"] * 5 + ["04"] * 4 + ["05"] * 3


@pytest.fixture(scope="module")
def shop(make):
    behaviors = make.behaviors([
        (f"B{i:02d}", u, "I1", t, f"2026-08-{d}T{10 + i}:00:00") for i, (u, t, d) in enumerate(zip(USERS, TYPES, DAYS))])
    users = make.users([(f"U{i}", 30, "MF"[i % 2], "2026-07-01T00:00:00") for i in range(1, 5)])
    items = make.items([("I1", "华为 手机", "C01", "华为", 3999, 1, "2026-07-20T00:00:00"),
                        ("I2", "小米 手机", "C01", "小米", 2999, 1, "2026-01-01T00:00:00"),
                        ("I3", "华为 壳", "C02", "华为", 199, 1, "2026-01-01T00:00:00")])
    orders = make.orders([("O1", "U1", "2026-08-01T10:00:00", 3999, "paid"), ("O2", "U2", "2026-08-01T11:00:00", 2999, "paid"),
                          ("O3", "U3", "2026-08-02T10:00:00", 199, "paid"), ("O4", "U4", "2026-08-03T10:00:00", 0, "cancelled")])
    lines = make.lines([("O1", "I1", 1, 3999), ("O2", "I2", 1, 2999), ("O3", "I3", 1, 199)])
    return users, items, behaviors, orders, lines


def test_funnel(shop):
    steps = by(activity.conversion_funnel(shop[2]), "stage")
    assert [steps[s]["count"] for s in ("pv", "click", "collect", "cart", "buy")] == [5, 3, 1, 2, 1]
    assert steps["pv"]["step_conversion_rate"] == 1.0
    assert steps["click"]["step_conversion_rate"] == 0.6
    assert steps["buy"]["overall_conversion_rate"] == 0.2


def test_gmv(shop):
    users, items, behaviors, orders, lines = shop
    row = revenue.gmv_summary(orders, behaviors).first()
    assert (row["gmv_total"], row["order_count"], row["buying_users"], row["aov"], row["arpu"]) == (7197.0, 3, 3, 2399.0, 2399.0)
    trend = by(revenue.gmv_trend(orders, behaviors).filter("grain = 'day'"), "bucket")
    assert trend["2026-08-01"]["orders"] == 2 and trend["2026-08-02"]["orders"] == 1
    status = by(revenue.status_distribution(orders), "status")
    assert (status["paid"]["count"], status["cancelled"]["count"], status["refunded"]["count"]) == (3, 1, 0)


def test_rankings(shop):
    users, items, behaviors, orders, lines = shop
    top = revenue.item_ranking(items, behaviors, lines, orders).first()
    assert top["item_id"] == "I1" and top["gmv"] == 3999.0
    assert by(revenue.category_ranking(items, behaviors, lines, orders), "category_id")["C01"]["gmv"] == 6998.0
    brand = by(revenue.brand_ranking(items, behaviors, lines, orders), "brand")["华为"]
    assert (brand["gmv"], brand["buy_users"]) == (4198.0, 2)


def test_cohorts_start_with_first_activity(shop):
    cohorts = retention.cohort_analysis(shop[2])
    sizes = {str(k): r["size"] for k, r in by(cohorts, "cohort_date").items()}
    assert sizes == {"2026-08-03": 1, "2026-08-04": 1, "2026-08-05": 1}
    assert retention.cohort_aggregate(cohorts).first()["total_users"] == 3
    with pytest.raises(ValueError):
        retention.cohort_analysis(shop[2], base="register")


@pytest.fixture(scope="module")
def rfm_orders(make):
    paid = [("O1", "U1", "2026-08-01T00:00:00", 1000), ("O2", "U1", "2026-08-03T00:00:00", 1000), ("O3", "U1", "2026-08-05T00:00:00", 1000),
            ("O4", "U1", "2026-08-06T00:00:00", 1000), ("O5", "U2", "2026-08-01T00:00:00", 500), ("O7", "U3", "2026-07-01T00:00:00", 300)]
    return make.orders([(*r, "paid") for r in paid] + [("O6", "U2", "2026-08-02T00:00:00", 0, "cancelled")])


def test_rfm(rfm_orders):
    rows = by(value.rfm(rfm_orders, RfmSettings(as_of="2026-08-07")), "user_id")
    u1, u2, u3 = rows["U1"], rows["U2"], rows["U3"]
    assert (u1["recency_days"], u1["r_score"], u1["f_score"], u1["m_score"], u1["segment"]) == (1, 5, 4, 4, "高价值")
    assert (u2["r_score"], u2["f_score"], u2["segment"]) == (5, 2, "潜力")
    assert (u3["r_score"], u3["m_score"], u3["segment"]) == (4, 1, "流失风险")
    total = value.rfm_segments(value.rfm(rfm_orders, RfmSettings(as_of="2026-08-07"))).agg(F.sum("gmv")).first()[0]
    assert total == 4800.0
    custom = by(value.rfm(rfm_orders, RfmSettings(as_of="2026-08-07", r_bins=(1, 2, 3, 4))), "user_id")
    assert (custom["U1"]["r_score"], custom["U3"]["r_score"]) == (4, 1)


def test_elapsed_days_are_not_calendar_days(make):
    """Recency is whole 24-hour spans: 15.58 days are 15."""
    orders = make.orders([("O1", "U1", "2026-08-15T10:00:00", 10, "paid")])
    assert value.rfm(orders, RfmSettings(as_of="2026-08-31")).first()["recency_days"] == 15


@pytest.mark.parametrize("gap, sessions", [(60, 1), (30, 1), (20, 2)])
def test_session_gap_is_strict(make, gap, sessions):
    b = make.behaviors([("B1", "U1", "I1", "pv", "2026-08-03T10:10:00"), ("B2", "U1", "I1", "pv", "2026-08-03T10:40:00")])
    assert paths.session_paths(b, gap).count() == sessions


def test_paths_collapse_repeats_across_hours(make):
    """One session over three clock hours, with repeats on both sides of an hour."""
    rows = [("10:50", "pv"), ("10:59", "click"), ("11:05", "click"), ("11:30", "pv"), ("11:58", "buy"), ("12:10", "buy")]
    b = make.behaviors([(f"B{i}", "U1", "I1", t, f"2026-08-03T{h}:00") for i, (h, t) in enumerate(rows)])
    row = paths.top_paths(b).first()
    assert (row["path"], row["sessions"], row["buy_sessions"]) == ("pv→click→pv→buy", 1, 1)
    assert paths.path_totals(b).first()["longest_tokens"] == 4


def test_item_stages_and_sparse_windows(make):
    items = make.items([("I1", "a", "C", "b", 1, 1, "2026-07-20T00:00:00")] + [
        (i, "a", "C", "b", 1, 1, "2026-01-01T00:00:00") for i in ("I2", "I3", "I4")])
    rows = [("I1", "2026-08-05", 1), ("I3", "2026-08-10", 20), ("I2", "2026-07-15", 2), ("I2", "2026-08-08", 3)]
    b = make.behaviors([(f"{i}{d}{n}", "U1", i, "buy", f"{d}T00:00:00") for i, d, k in rows for n in range(k)])
    none = make.orders([("O", "U9", "2026-01-01T00:00:00", 1, "cancelled")]), make.lines([("O", "I9", 1, 1)])
    got = by(catalogue.item_lifecycle(items, b, none[1], none[0]), "item_id")
    assert got["I1"]["stage"] == "新品" and got["I4"]["stage"] == "无购买"
    assert got["I2"]["buy_trend"] == [2, 3] and got["I2"]["stage"] == "成长"
    full = by(catalogue.item_lifecycle(items, b, none[1], none[0], ItemLifeSettings(zero_fill=True)), "item_id")
    assert full["I2"]["buy_trend"] == [2, 0, 0, 3]


def test_basket_rules(make):
    orders = make.orders([(f"O{i}", "U1", "2026-08-01T00:00:00", 1, "paid") for i in range(1, 5)])
    lines = make.lines([(f"O{i}", x, 1, 1) for i in (1, 2, 3) for x in ("I1", "I2")] + [("O4", "I3", 1, 1)])
    items = make.items([(f"I{i}", f"n{i}", "C1", "b", 1, 1, "2026-01-01T00:00:00") for i in (1, 2, 3)])
    cfg = BasketSettings(min_support=0.5, min_confidence=0.5, min_lift=0.5)
    rules = by(baskets.item_rules(lines, orders, items, cfg), "antecedent_id", "consequent_id")
    assert set(rules) == {("I1", "I2"), ("I2", "I1")}
    r = rules[("I1", "I2")]
    assert (r["support"], r["confidence"], r["lift"], r["count"]) == (0.75, 1.0, 1.3333, 3)


def test_price_bins_of_one_price(make):
    items = make.items([(f"I{i}", "n", "C", "b", 5, 1, "2026-01-01T00:00:00") for i in range(4)])
    assert catalogue.binned_items(items, 5).select("bin").distinct().count() == 1
