"""Registered queries for operators whose own output SQL cannot repeat: properties that SQL can state."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import features as T
from ..operators import lookup as L
from ..operators import models as M
from ..operators import snapshots as G
from ..plans.features import feature_dictionary
from ..plans.prediction import load_model, save_models
from ..session import cut_lineage, scratch_path
from ..settings import ModelSettings
from .panels import _PANEL, _PANEL_ENDS, _split, _tables
from .registry import register

_TRAIN = """
, k AS (SELECT obs_end, row_number() OVER (ORDER BY obs_end) AS p, (SELECT count(*) FROM ends) AS n FROM ends),
train AS (SELECT obs_end FROM k WHERE p <= n - round(n * 0.2) - greatest(1, round(n * 0.2)))
"""


def _fitted(w, only):
    """Model and training rows of the purchase panel, which is written once."""
    train = cut_lineage(_split(w).filter("split = 'train'"))
    return M.fit_models(train, ModelSettings(), only)[only], train


def _balance(w):
    """At the optimum of a logistic model with a free intercept the weighted residuals sum to zero."""
    model, train = _fitted(w, "logistic_regression")
    weighed = model.transform(M.balanced_weights(M._numeric(train)))
    residual = F.col("class_weight") * (F.get(vector_to_array("probability"), 1) - F.col("label"))
    return weighed.agg(F.count(F.lit(1)).alias("rows"), F.abs(F.round(F.sum(residual) / F.count(F.lit(1)), 3)).alias("residual"))


register("G08_logistic_optimum", _balance, _PANEL_ENDS + _TRAIN + """
SELECT (SELECT count(*) FROM w_users) * (SELECT count(*) FROM train) AS rows, 0.0 AS residual""")


def _importances(w):
    model, train = _fitted(w, "random_forest")
    table = M.feature_importance({"random_forest": model}, train.sparkSession, top_n=1000)
    return table.agg(F.count(F.lit(1)).alias("features"), F.count_if(F.col("value") >= 0).alias("not_negative"),
                     F.round(F.sum("value"), 2).alias("total"))


register("G09_G12_forest_importances", _importances, f"SELECT {len(T.USER_FEATURES)} AS features, {len(T.USER_FEATURES)} AS not_negative, 1.0 AS total")


def _told_apart(w):
    """A label that one feature decides: both models must rank almost all pairs right."""
    panel = cut_lineage(_split(w).withColumn("label", (F.col("total_behaviors") >= 20).cast("int")))
    _, metrics, _ = M.train_and_evaluate(panel, ModelSettings())
    return metrics.filter("split = 'test'").select("model", "split", "n_samples", (F.col("roc_auc") > 0.95).alias("told_apart"))


register("G11_models_learn_a_known_rule", _told_apart, _PANEL_ENDS + """
, k AS (SELECT count(*) AS n FROM ends)
SELECT m.model, 'test' AS split, (SELECT count(*) FROM w_users) * CAST(greatest(1, round(n * 0.2)) AS BIGINT) AS n_samples, 1 AS told_apart
FROM k, (VALUES ('logistic_regression'), ('random_forest')) AS m(model)""")


def _same_scores(w):
    """Scores of a model in memory against those of the model saved and loaded."""
    model, train = _fitted(w, "logistic_regression")
    folder = scratch_path(train.sparkSession, "models")
    save_models({"logistic_regression": model}, folder)
    a = M.score_latest_per_user(model, train)
    b = M.score_latest_per_user(load_model(folder, "logistic_regression"), train).withColumnRenamed("purchase_probability", "again")
    return a.join(b, ["user_id", "obs_end"], "full").groupBy("obs_end").agg(
        F.count(F.lit(1)).alias("users"), F.count_if(~F.col("purchase_probability").eqNullSafe(F.col("again"))).alias("differing"))


register("A11_saved_model_scores_alike", _same_scores, _PANEL_ENDS + _TRAIN + """
SELECT CAST((SELECT max(obs_end) FROM train) AS VARCHAR) AS obs_end, (SELECT count(*) FROM w_users) AS users, 0 AS differing""")


def _cluster_sizes(w):
    sizes = M.assign_clusters(M.segmentation_features(w.behaviors, w.orders)).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("cluster_id", "n")))
    falling = F.forall(F.sequence(F.lit(1), F.size("o") - 1), lambda i: F.get(F.col("o"), i)["n"] <= F.get(F.col("o"), i - 1)["n"])
    return sizes.agg(F.sum("n").alias("users"), ordered.alias("o")).select("users", falling.alias("falling"))


register("E15_cluster_sizes", _cluster_sizes, "SELECT count(DISTINCT user_id) AS users, 1 AS falling FROM behaviors")


def _named_clusters(w):
    """The clusters of all users, named: every user lies in one, and every cluster has one of the known names."""
    named = M.name_clusters(M.assign_clusters(M.segmentation_features(w.behaviors, w.orders)))
    return named.agg(F.sum("size").alias("users"), F.count(F.lit(1)).alias("clusters"), F.count("cluster_name").alias("named"))


register("E16_named_clusters", _named_clusters, "SELECT count(DISTINCT user_id) AS users, 4 AS clusters, 4 AS named FROM behaviors")


def _dictionary_counts(w):
    table = feature_dictionary({"user_features": T.user_features(*_tables(w)), "user_item_features": T.user_item_features(w.behaviors, w.items)})
    keys = table.filter(F.col("field").isin("user_id", "item_id", "total_behaviors"))
    return keys.select("table_name", "field", "rows", "filled")


register("F04_dictionary_counts", _dictionary_counts, """
, win AS (SELECT * FROM behaviors WHERE event_date BETWEEN (SELECT max(event_date) FROM behaviors) - 29 AND (SELECT max(event_date) FROM behaviors)),
u AS (SELECT count(*) AS n FROM w_users), p AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id, item_id FROM win))
SELECT 'user_features' AS table_name, f AS field, n AS rows, n AS filled FROM u, (VALUES ('user_id'), ('total_behaviors')) AS t(f)
UNION ALL SELECT 'user_item_features', f, n, n FROM p, (VALUES ('user_id'), ('item_id'), ('total_behaviors')) AS t(f)""")
register("J04_nested_history", lambda w: L.nested_history(L.order_history(w.orders, w.order_items, w.items)).select(
    "user_id", "order_id", "status", F.size("lines").alias("n_lines"),
    F.round(F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["amount"]), 2).alias("amount"), "paid_orders"), """
, p AS (SELECT user_id, count(*) AS n FROM w_orders WHERE status = 'paid' GROUP BY 1)
SELECT o.user_id, o.order_id, o.status, count(l.order_id) AS n_lines, coalesce(round(sum(l.amount), 2), 0.0) AS amount, coalesce(any_value(n), 0) AS paid_orders
FROM w_orders o LEFT JOIN w_lines l USING (order_id) LEFT JOIN p ON p.user_id = o.user_id GROUP BY 1, 2, 3""", "order")
