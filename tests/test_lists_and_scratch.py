"""Numbered lists with clustered scores, topped-up lists, whole recommendation runs, scratch folders."""

import pytest
from pyspark.sql import functions as F

from stallwise.operators import recommend as H
from stallwise.operators.profiles import findings
from stallwise.plans.recommend import run_recommendations
from stallwise.session import scratch_path
from stallwise.settings import EvaluationSettings, RecommendSettings

NEW = "2026-01-01T00:00:00"


@pytest.fixture(scope="module")
def shop(make):
    items = make.items([(f"I{i}", f"name{i} thing", f"C{i % 2}", f"b{i % 3}", 10 * i, 1, NEW) for i in range(1, 8)])
    acts = [("U1", "I1", "buy"), ("U1", "I2", "pv"), ("U2", "I1", "pv"), ("U3", "I3", "buy"), ("U3", "I4", "pv"), ("U4", "I4", "buy"), ("U5", "I5", "pv"),
            ("U5", "I6", "pv"), ("U2", "I2", "buy"), ("U4", "I3", "buy"), ("U1", "I6", "buy"), ("U3", "I1", "buy")]
    behaviors = make.behaviors([(f"B{n}", u, i, t, f"2026-08-{10 + n}T10:00:00") for n, (u, i, t) in enumerate(acts)])
    orders = make.orders([("O1", "U3", "2026-08-12T10:00:00", 10, "paid")])
    lines = make.lines([("O1", "I3", 1, 10)])
    users = make.users([(f"U{i}", 30, "M", NEW) for i in range(1, 7)])
    return behaviors, items, orders, lines, users


def test_positions_with_scores_in_one_corner(spark):
    """99 of 100 scores lie below 1 / 4096; places are still those of a plain sort, over many buckets."""
    scores = spark.range(3000).select(F.col("id").alias("item_id"), F.when(F.col("id") % 100 == 0, F.lit(1.0)).otherwise(
        (F.col("id") % 7) / 100000.0).alias("score"))
    got = {r.item_id: r.position for r in H.positions(scores).collect()}
    want = sorted(range(3000), key=lambda i: (-(1.0 if i % 100 == 0 else round(i % 7 / 100000.0, 6)), i))
    assert got == {item: place for place, item in enumerate(want, 1)}


@pytest.mark.parametrize("algorithm", ["itemcf", "usercf", "content"])
def test_short_lists_are_topped_up(shop, algorithm):
    behaviors, items, orders, lines, users = shop
    cfg = RecommendSettings(top_k=5)
    rows = H.recommend(algorithm, behaviors, items, orders, lines, users, cfg).collect()
    for user in ("U1", "U2", "U3", "U4", "U5"):
        mine = sorted((r for r in rows if r.user_id == user), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5], user
        assert len({r.item_id for r in mine}) == 5 and all(a.score >= b.score for a, b in zip(mine, mine[1:]))
        assert user != "U3" or "I3" not in {r.item_id for r in mine}


def test_a_whole_run_evaluates_every_user(spark, shop, tmp_path):
    behaviors, items, orders, lines, users = shop
    out = str(tmp_path / "run")
    tables = {"user_behaviors": behaviors, "items": items, "orders": orders, "order_items": lines, "users": users}
    run_recommendations(spark, tables, out, RecommendSettings(top_k=3), EvaluationSettings(k=3))
    compared = spark.read.json(f"{out}/comparison").collect()
    truth = behaviors.filter("event_date > date'2026-08-18'").select("user_id").distinct().count()
    assert len(compared) == len(H.RECOMMENDERS) and {r.n_users for r in compared} == {truth}
    assert sorted(r["rank"] for r in compared) == [1, 2, 3, 4, 5]
    assert spark.read.json(f"{out}/weight_experiment").count() == 3


def test_findings_leave_out_what_is_absent_or_empty(spark):
    rules = spark.createDataFrame([], "antecedent string, consequent string, lift double")
    rates = spark.createDataFrame([(1, 0.5), (7, 0.25)], "offset int, rate double")
    got = [tuple(r) for r in findings({"item_rules": rules, "retention": rates}).collect()]
    assert got == [("retention", "rate", "1", 0.5), ("retention", "rate", "7", 0.25)]


class _Settings:
    def __init__(self, **values):
        self.values = {k.replace("__", "."): v for k, v in values.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.values.get(key, default)


def test_scratch_is_shared_storage_with_and_without_the_setting():
    named = _Settings(spark__checkpoint__dir="hdfs://store/shared/", spark__sql__warehouse__dir="hdfs://store/wh")
    assert scratch_path(named, "cut").startswith("hdfs://store/shared/cut-")
    bare = _Settings(spark__sql__warehouse__dir="hdfs://store/wh/")
    assert scratch_path(bare, "cut").startswith("hdfs://store/wh/_scratch/cut-")
