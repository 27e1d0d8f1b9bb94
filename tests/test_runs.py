"""Whole runs on the smallest folder: everything is written and can be read back."""

import os

import pytest

import __spark_entry__ as contract
from stallwise.plans.analysis import analyses, run_analysis
from stallwise.plans.features import run_features
from stallwise.plans.prediction import load_model, run_models
from stallwise.plans.recommend import batch_recommendations
from stallwise.settings import ModelSettings, SnapshotSettings
from stallwise.sources.worlds import event_world

pytestmark = pytest.mark.skipif(not os.path.isdir(contract.SMOKE_DIR), reason="data folder absent")


@pytest.fixture(scope="module")
def tables(spark):
    w = event_world(spark, contract.SMOKE_DIR)
    return {"users": w.users, "items": w.items, "user_behaviors": w.behaviors, "orders": w.orders, "order_items": w.order_items}


def test_analysis_run(spark, tables, tmp_path):
    out = str(tmp_path)
    assert run_analysis(spark, tables, out).count() == 1
    assert {d for d in os.listdir(out)} == set(analyses(tables)) | {"run_record"}
    assert spark.read.json(f"{out}/funnel").count() == 5
    assert spark.read.parquet(f"{out}/user_profile").count() == tables["users"].count()


def test_feature_run(spark, tables, tmp_path):
    out = str(tmp_path)
    run_features(spark, tables, out)
    first = spark.read.parquet(f"{out}/user_features")
    assert len(first.columns) == 39 and first.count() == tables["users"].count()
    assert spark.read.json(f"{out}/feature_dictionary").count() == 39 + 22 + 14
    before = sorted(map(str, first.collect()))
    run_features(spark, tables, out)
    assert sorted(map(str, spark.read.parquet(f"{out}/user_features").collect())) == before


def test_model_run(spark, tables, tmp_path):
    out = str(tmp_path)
    panel = SnapshotSettings(observation_days=14, label_days=7, step_days=3)
    run_models(spark, tables, out, "churn", panel, ModelSettings(trees=5, max_depth=3, max_iter=10))
    metrics = spark.read.json(f"{out}/metrics")
    assert metrics.count() == 4 and metrics.filter("accuracy between 0 and 1").count() == 4
    scores = spark.read.parquet(f"{out}/scores")
    assert scores.count() > 0 and scores.filter("churn_probability between 0 and 1").count() == scores.count()
    assert load_model(f"{out}/models", "random_forest").stages


def test_batch_lists(spark, tables):
    users = tables["user_behaviors"].select("user_id").distinct()
    lists = batch_recommendations(tables["user_behaviors"], tables["items"], tables["orders"], tables["order_items"], users,
                                  algorithms=("popular", "content"))
    assert lists.groupBy("algorithm", "user_id").count().filter("count > 10").count() == 0
    assert lists.select("user_id").distinct().count() == users.count()
