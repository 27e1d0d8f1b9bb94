"""Recommenders and ranking metrics on small shops."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import by
from stallwise.operators import evaluation as I
from stallwise.operators import recommend as H
from stallwise.settings import EvaluationSettings, RecommendSettings

NEW = "2026-01-01T00:00:00"


@pytest.fixture(scope="module")
def shop(make):
    items = make.items([(f"I{i}", f"name{i % 3} thing", f"C{i % 2}", f"b{i % 2}", 10 * i, 0 if i == 5 else 1, NEW) for i in range(1, 6)])
    acts = [("U1", "I1", "buy"), ("U1", "I2", "buy"), ("U2", "I1", "buy"), ("U2", "I3", "buy"), ("U3", "I4", "buy"), ("U3", "I2", "buy"),
            ("U4", "I4", "pv"), ("U4", "I1", "pv"), ("U2", "I5", "pv")]
    behaviors = make.behaviors([(f"B{n}", u, i, t, f"2026-08-{10 + n}T10:00:00") for n, (u, i, t) in enumerate(acts)])
    orders = make.orders([("O1", "U3", "2026-08-15T10:00:00", 10, "paid")])
    lines = make.lines([("O1", "I4", 1, 10)])
    users = make.users([(f"U{i}", 30, "M", NEW) for i in range(1, 6)])
    return behaviors, items, orders, lines, users


@pytest.fixture(scope="module")
def lists(shop):
    return {a: H.recommend(a, *shop).collect() for a in H.RECOMMENDERS}


@pytest.mark.parametrize("algorithm", list(H.RECOMMENDERS))
def test_list_contract(lists, algorithm):
    rows = lists[algorithm]
    assert {r["user_id"] for r in rows} == {"U1", "U2", "U3", "U4", "U5"}, "users without history get a list too"
    assert not any(r["item_id"] == "I5" for r in rows), "off the shelf"
    assert not any(r["item_id"] == "I4" for r in rows if r["user_id"] == "U3"), "already bought"
    for u in "U1", "U5":
        mine = sorted((r for r in rows if r["user_id"] == u), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert len({r["item_id"] for r in mine}) == len(mine)
        assert all(a["score"] >= b["score"] for a, b in zip(mine, mine[1:]))


def test_neighbours_bring_their_items(lists):
    assert "I2" in {r["item_id"] for r in lists["itemcf"] if r["user_id"] == "U4"}
    assert {"I3", "I4"} & {r["item_id"] for r in lists["usercf"] if r["user_id"] == "U1"}


def test_hybrid_with_one_weight_follows_that_part(shop):
    cfg = RecommendSettings(blend={"content": 1.0})
    blended = H.recommend_hybrid(*shop, cfg).filter("user_id = 'U1'").orderBy("rank").collect()
    alone = H.recommend_content(*shop, cfg).filter("user_id = 'U1'").orderBy("rank").collect()
    assert [r["item_id"] for r in blended][:3] == [r["item_id"] for r in alone][:3]


def test_one_purchase_beats_many_views(make):
    items = make.items([(f"I{i}", "n", "C", "b", 1, 1, NEW) for i in (1, 2)])
    rows = [(f"B{n}", f"U{n}", "I1", "pv", "2026-08-31T10:00:00") for n in range(14)] + [("B99", "U1", "I2", "buy", "2026-08-31T10:00:00")]
    top = H.popular_scores(make.behaviors(rows)).orderBy(F.desc("score")).first()
    assert top["item_id"] == "I2" and top["score"] == 1.0


def test_similar_content_comes_first(make):
    items = make.items([("I1", "acme red shoe", "C1", "acme", 10, 1, NEW), ("I2", "acme blue shoe", "C1", "acme", 11, 1, NEW),
                        ("I3", "other lamp", "C2", "other", 90, 1, NEW), ("I4", "third chair", "C3", "third", 300, 1, NEW)])
    b = make.behaviors([("B1", "U1", "I1", "buy", "2026-08-31T10:00:00")])
    orders, lines = make.orders([("O1", "U1", "2026-08-31T10:00:00", 10, "paid")]), make.lines([("O1", "I1", 1, 10)])
    users = make.users([("U1", 30, "M", NEW)])
    assert H.recommend_content(b, items, orders, lines, users).filter("rank = 1").first()["item_id"] == "I2"
    brand_words = {r["feature"] for r in H.content_features(items).filter("item_id = 'I1'").collect()}
    assert "token=acme" not in brand_words and "token=red" in brand_words


def test_decay(spark):
    from stallwise.functions.scalar import time_decay
    row = spark.range(1).select(
        time_decay(F.lit("2026-08-08").cast("date"), F.lit("2026-08-01").cast("date"), 7).alias("half"),
        time_decay(F.lit("2026-08-08").cast("date"), F.lit("2026-08-01").cast("date"), 0).alias("flat")).first()
    assert row["half"] == 0.5 and row["flat"] == 1.0


def test_ranking_metrics(spark, make):
    recs = spark.createDataFrame([("U1", "I2", 1), ("U1", "I1", 2), ("U1", "I5", 3)], "user_id string, item_id string, rank int")
    truth = spark.createDataFrame([("U1", "I1"), ("U1", "I2"), ("U1", "I6"), ("U2", "I1")], "user_id string, item_id string")
    rows = by(I.ranking_metrics(recs, truth, 3), "user_id")
    u1 = rows["U1"]
    assert u1["precision"] == u1["recall"] == u1["f1"] == pytest.approx(2 / 3, abs=1e-6) and u1["hit_rate"] == 1.0
    gain = 1 + 1 / math.log2(3)
    assert u1["ndcg"] == pytest.approx(gain / (gain + 0.5), abs=1e-6)
    assert rows["U2"]["ndcg"] == 0.0 and rows["U2"]["hit_rate"] == 0.0
    items = make.items([(f"I{i}", "n", "C", "b", 1, 1, NEW) for i in range(1, 5)])
    shown = recs.filter("item_id <> 'I5'")
    assert items.limit(1).select(I.coverage(shown, items, 3)).first()[0] == 0.5


def test_later_purchases_stay_candidates_by_default(make):
    """What a user buys after the cut must be recommendable, unless the leaking filter is asked for."""
    items = make.items([(f"I{i}", "n", "C", "b", 1, 1, NEW) for i in (1, 2)])
    b = make.behaviors([("B1", "U1", "I1", "buy", "2026-08-01T10:00:00"), ("B2", "U2", "I2", "pv", "2026-08-02T10:00:00"),
                        ("B3", "U1", "I2", "buy", "2026-08-09T10:00:00")])
    orders, lines = make.orders([("O1", "U1", "2026-08-09T10:00:00", 1, "paid")]), make.lines([("O1", "I2", 1, 1)])
    cfg = EvaluationSettings(k=2)
    fair = I.evaluate_recommender("popular", b, items, orders, lines, cfg).first()
    leaky = I.evaluate_recommender("popular", b, items, orders, lines, cfg, leak_purchases=True).first()
    assert fair["hit_rate"] == 1.0 and leaky["hit_rate"] == 0.0


def test_conclusion_needs_a_strict_win(spark):
    table = spark.createDataFrame([("popular", 0.5), ("hybrid", 0.5), ("itemcf", 0.1)], "algorithm string, ndcg double")
    row = I.conclusion(table).first()
    assert row["candidate"] == "hybrid" and row["is_better"] is False
