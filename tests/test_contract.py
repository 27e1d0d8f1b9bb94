"""Registered queries against their SQL on the smallest folder."""

import os

import pytest

import __spark_entry__ as contract
from check_queries import difference, duck

FOLDER = contract.SMOKE_DIR
CHECKED = """A05_append_unseen_keys B08_deduplicate B09_reference_rule B13_reconcile_orders C07_sessions D01_user_scale D04_dau D14_gmv_trend_orders
D16_item_ranking D18_brand_ranking_orders D20_cohort_register D22_retention_overall D23_rfm_orders E01_user_lifecycle E04_path_totals
E05_item_lifecycle E08_price_bins_orders E10_channel E11_device E13_category_rules E17_user_profile F01_user_features F02_item_features
G04_purchase_dataset G10_classification_metrics H06_item_similarity H09_user_neighbors H14_content_top_k H15_hybrid_top_k I05_evaluate_popular
J03_recent_behaviors J05_kpi_overview K01_stream_page_views K05_stream_sessions""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="data folder absent")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_entry(spark):
    assert contract.entry(spark).count() == 5


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    got = contract.queries()[name](spark, FOLDER).toPandas()
    assert difference(got, con.execute(contract.oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", ["D17_category_ranking_orders", "E08_price_bins_orders", "E17_user_profile", "G04_purchase_dataset", "H07_itemcf_scores"])
def test_plans_hold_no_cross_join_and_no_python(spark, name):
    plan = contract.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython"):
        assert operator not in plan
