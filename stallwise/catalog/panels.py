"""Registered queries: feature tables, snapshot panels, labels, classifier metrics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as T
from ..operators import models as M
from ..operators import snapshots as G
from ..plans.features import feature_dictionary
from ..plans.prediction import load_model, save_models
from ..session import cut_lineage, scratch_path
from ..settings import FeatureSettings, ModelSettings, SnapshotSettings
from ..sources.tables import write_table
from .registry import register
from .sqltext import TYPES, counts, days_between, elapsed, rnd, sd, zeroed

_N = [f"n_{t}" for t in TYPES]
_ONE_END = ", ends AS (SELECT max(event_date) AS obs_end FROM behaviors)"
# the event table holds 30 days: shorter windows than the defaults are what fits several snapshots
_PANEL = SnapshotSettings(observation_days=14, label_days=7, step_days=3)
_PANEL_ENDS = """
, rng AS (SELECT CAST(min(event_date) + 13 AS DATE) AS lo, CAST(max(event_date) - 7 AS DATE) AS hi FROM behaviors),
ends AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 3 DAY)) AS DATE) AS obs_end FROM rng)
"""


def user_feature_sql(days: int) -> str:
    return f"""
, fb AS (SELECT b.*, obs_end FROM behaviors b JOIN ends ON event_date BETWEEN obs_end - {days - 1} AND obs_end),
fs AS (SELECT user_id, obs_end, count(*) FILTER (pt IS NULL OR event_time - pt > INTERVAL 30 MINUTE) AS n_sessions
  FROM (SELECT user_id, obs_end, event_time, lag(event_time) OVER (PARTITION BY obs_end, user_id ORDER BY event_time, behavior_id) AS pt FROM fb) GROUP BY 1, 2),
fa AS (SELECT user_id, obs_end, {counts('n_')}, count(*) AS total_behaviors, count(DISTINCT event_date) AS n_active_days,
  count(DISTINCT fb.item_id) AS n_distinct_items, count(DISTINCT category_id) AS n_distinct_categories, count(DISTINCT channel) AS n_channels,
  count(DISTINCT device_type) AS n_devices, max(event_date) AS last_active, min(event_date) AS first_active
  FROM fb LEFT JOIN w_items USING (item_id) GROUP BY 1, 2),
ftc AS (SELECT user_id, obs_end, channel AS top_channel FROM (SELECT *, row_number() OVER (PARTITION BY user_id, obs_end ORDER BY n DESC, channel) AS k
  FROM (SELECT user_id, obs_end, channel, count(*) AS n FROM fb GROUP BY 1, 2, 3)) WHERE k = 1),
ftd AS (SELECT user_id, obs_end, device_type AS top_device FROM (SELECT *, row_number() OVER (PARTITION BY user_id, obs_end ORDER BY n DESC, device_type) AS k
  FROM (SELECT user_id, obs_end, device_type, count(*) AS n FROM fb GROUP BY 1, 2, 3)) WHERE k = 1),
fo AS (SELECT o.*, obs_end FROM w_orders o JOIN ends ON order_time >= CAST(obs_end - {days - 1} AS TIMESTAMP) AND order_time <= CAST(obs_end AS TIMESTAMP) WHERE status = 'paid'),
fp AS (SELECT user_id, obs_end, count(*) AS paid_order_count, round(sum(total_amount), 2) AS paid_gmv, max(total_amount) AS max_order_amount,
  count(DISTINCT CAST(order_time AS DATE)) AS purchase_days FROM fo GROUP BY 1, 2),
fi AS (SELECT fo.user_id, obs_end, count(DISTINCT l.item_id) AS purchased_items, count(DISTINCT category_id) AS purchased_categories
  FROM fo JOIN w_lines l USING (order_id) LEFT JOIN w_items USING (item_id) GROUP BY 1, 2),
fj AS (SELECT u.user_id, e.obs_end, u.age, u.gender, u.register_time, last_active, first_active, coalesce(top_channel, '') AS top_channel, coalesce(top_device, '') AS top_device,
  {zeroed([*_N, 'total_behaviors', 'n_active_days', 'n_distinct_items', 'n_distinct_categories', 'n_channels', 'n_devices', 'n_sessions',
           'paid_order_count', 'purchase_days', 'purchased_items', 'purchased_categories'])},
  coalesce(paid_gmv, 0.0) AS paid_gmv, coalesce(max_order_amount, 0.0) AS max_order_amount
  FROM w_users u CROSS JOIN ends e LEFT JOIN fa USING (user_id, obs_end) LEFT JOIN fs USING (user_id, obs_end) LEFT JOIN ftc USING (user_id, obs_end)
  LEFT JOIN ftd USING (user_id, obs_end) LEFT JOIN fp USING (user_id, obs_end) LEFT JOIN fi USING (user_id, obs_end)),
feat AS (SELECT user_id, obs_end, age, coalesce(CAST(gender = 'M' AS BIGINT), 0) AS gender_m, coalesce(CAST(gender = 'F' AS BIGINT), 0) AS gender_f,
  greatest({elapsed('CAST(obs_end AS TIMESTAMP)', 'register_time')}, 0) AS register_days,
  CAST(register_time >= CAST(obs_end - {days - 1} AS TIMESTAMP) AND register_time <= CAST(obs_end AS TIMESTAMP) AS BIGINT) AS is_new_in_window,
  total_behaviors, {', '.join(_N)}, {sd('n_buy', 'total_behaviors')} AS behavior_buy_ratio, n_active_days,
  least(n_active_days / {float(days)}, 1.0)::DOUBLE AS active_day_ratio, {sd('total_behaviors', 'n_active_days')} AS behaviors_per_active_day,
  (total_behaviors / {float(days)})::DOUBLE AS avg_behaviors_per_day, n_sessions, {sd('total_behaviors', 'n_sessions')} AS behaviors_per_session,
  coalesce({days_between('obs_end', 'last_active')}, {days}) AS recency_days,
  coalesce({days_between('first_active', f'(obs_end - {days - 1})')}, 0) AS first_activity_offset_days,
  n_distinct_items, n_distinct_categories, n_channels, n_devices,
  {', '.join(sd(f'n_{t}', 'n_pv') + f' AS {t}_rate' for t in TYPES[1:])},
  paid_order_count, paid_gmv, {sd('paid_gmv', 'paid_order_count')} AS avg_order_amount, max_order_amount, purchased_items, purchased_categories, purchase_days,
  CAST(paid_order_count > 0 AS BIGINT) AS has_purchase, top_channel, top_device FROM fj)
"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("active_day_ratio", "avg_behaviors_per_day")})


_FEAT_OUT = "SELECT * EXCLUDE (obs_end) REPLACE (round(active_day_ratio, 6) AS active_day_ratio, round(avg_behaviors_per_day, 6) AS avg_behaviors_per_day) FROM feat"
_PANEL_OUT = """SELECT f.* REPLACE (CAST(f.obs_end AS VARCHAR) AS obs_end, round(active_day_ratio, 6) AS active_day_ratio,
 round(avg_behaviors_per_day, 6) AS avg_behaviors_per_day), CAST({label} AS BIGINT) AS label FROM feat f """


def _tables(w):
    return w.users, w.behaviors, w.orders, w.order_items, w.items


register("F01_user_features", lambda w: _rounded(T.user_features(*_tables(w))), _ONE_END + user_feature_sql(30) + _FEAT_OUT)
register("F01_user_features_14_days", lambda w: _rounded(T.user_features(*_tables(w), FeatureSettings(observation_days=14, obs_end="2024-01-20"))),
         ", ends AS (SELECT DATE '2024-01-20' AS obs_end)" + user_feature_sql(14) + _FEAT_OUT)


def _written_features(w):
    path = scratch_path(w.users.sparkSession, "user_features")
    write_table(T.user_features(*_tables(w)), path)
    return _rounded(w.users.sparkSession.read.parquet(path))


register("A10_feature_sink", _written_features, _ONE_END + user_feature_sql(30) + _FEAT_OUT)
for _name, _cols in {
    "F01a_static": ("age", "gender_m", "gender_f", "register_days", "is_new_in_window"),
    "F01b_activity": ("total_behaviors", "n_active_days", "n_distinct_items", "n_distinct_categories", "n_channels", "n_devices"),
    "F01c_sessions": ("n_sessions", "behaviors_per_session"),
    "F01d_favourites": ("top_channel", "top_device"),
    "F01e_purchases": ("paid_order_count", "paid_gmv", "max_order_amount", "purchase_days", "purchased_items", "purchased_categories"),
    "F01f_ratios": ("recency_days", "first_activity_offset_days", "behavior_buy_ratio", "click_rate", "buy_rate", "avg_order_amount"),
}.items():
    register(_name, lambda w, c=_cols: T.user_features(*_tables(w)).select("user_id", *c),
             _ONE_END + user_feature_sql(30) + f"SELECT user_id, {', '.join(_cols)} FROM feat")

register("F02_item_features", lambda w: T.item_features(w.items, w.behaviors, w.order_items, w.orders).withColumn("heat_score", F.round("heat_score", 4)),
         _ONE_END + f"""
, b AS (SELECT * FROM behaviors, ends WHERE event_date BETWEEN obs_end - 29 AND obs_end),
c AS (SELECT item_id, {counts('n_')}, count(DISTINCT user_id) AS n_unique_users, max(event_date) AS last_active FROM b GROUP BY 1),
o AS (SELECT w_orders.* FROM w_orders, ends WHERE status = 'paid' AND order_time BETWEEN CAST(obs_end - 29 AS TIMESTAMP) AND CAST(obs_end AS TIMESTAMP)),
s AS (SELECT item_id, CAST(sum(quantity) AS BIGINT) AS units_sold, round(sum(amount), 2) AS gmv, count(DISTINCT order_id) AS n_paid_orders, count(DISTINCT user_id) AS n_buying_users
      FROM w_lines JOIN o USING (order_id) GROUP BY 1),
j AS (SELECT i.*, obs_end, last_active, {zeroed([*_N, 'n_unique_users', 'units_sold', 'n_paid_orders', 'n_buying_users'])}, coalesce(gmv, 0.0) AS gmv
      FROM w_items i LEFT JOIN c USING (item_id) LEFT JOIN s USING (item_id), ends)
SELECT item_id, item_name, category_id, brand, price, stock, status, greatest({elapsed('CAST(obs_end AS TIMESTAMP)', 'created_at')}, 0) AS days_listed,
 {', '.join(_N)}, {' + '.join(_N)} AS total_behaviors, n_unique_users, coalesce({days_between('obs_end', 'last_active')}, 30) AS last_behavior_offset_days,
 units_sold, gmv, n_paid_orders, n_buying_users, {sd('n_buy', 'n_pv')} AS conversion_rate,
 {rnd('n_pv + 2*n_click + 3*n_collect + 4*n_cart + 5*n_buy + gmv / 100.0', 4)} AS heat_score FROM j""")
register("F03_user_item_features", lambda w: T.user_item_features(w.behaviors, w.items), _ONE_END + f"""
, c AS (SELECT user_id, item_id, obs_end, {counts('n_')}, min(event_date) AS f, max(event_date) AS l FROM behaviors, ends
        WHERE event_date BETWEEN obs_end - 29 AND obs_end GROUP BY 1, 2, 3)
SELECT user_id, item_id, category_id, {', '.join(_N)}, {' + '.join(_N)} AS total_behaviors,
 CAST(n_pv + 2*n_click + 3*n_collect + 4*n_cart + 5*n_buy AS DOUBLE) AS weighted_score, {days_between('f', '(obs_end - 29)')} AS first_activity_offset_days,
 {days_between('l', '(obs_end - 29)')} AS last_activity_offset_days, {days_between('obs_end', 'l')} AS days_since_last, CAST(n_buy > 0 AS BIGINT) AS is_bought
FROM c LEFT JOIN w_items USING (item_id)""")
register("F04_feature_dictionary", lambda w: feature_dictionary({
    "user_features": T.user_features(*_tables(w)), "item_features": T.item_features(w.items, w.behaviors, w.order_items, w.orders),
    "user_item_features": T.user_item_features(w.behaviors, w.items)}))

register("G01_snapshot_range", lambda w: G.snapshot_range(w.behaviors, _PANEL), _PANEL_ENDS + "SELECT CAST(lo AS VARCHAR) AS earliest, CAST(hi AS VARCHAR) AS latest FROM rng")
register("G02_snapshot_calendar", lambda w: G.snapshot_calendar(w.behaviors, _PANEL), _PANEL_ENDS + "SELECT CAST(obs_end AS VARCHAR) AS obs_end FROM ends")
_BUYERS = """
, buyers AS (SELECT DISTINCT user_id, obs_end FROM w_orders JOIN ends ON order_time > CAST(obs_end AS TIMESTAMP) AND order_time <= CAST(obs_end + 7 AS TIMESTAMP) WHERE status = 'paid')
"""
_ALIVE = _BUYERS + """
, alive AS (SELECT user_id, obs_end FROM buyers UNION SELECT user_id, obs_end FROM behaviors JOIN ends ON event_date > obs_end AND event_date <= obs_end + 7
            WHERE behavior_type IN ('buy', 'collect', 'cart'))
"""
register("G03_purchase_label", lambda w: G.buyers_after(w.orders, G.snapshot_ends(w.behaviors, _PANEL), 7),
         _PANEL_ENDS + _BUYERS + "SELECT user_id, CAST(obs_end AS VARCHAR) AS obs_end FROM buyers")
register("G04_purchase_dataset", lambda w: _rounded(G.purchase_dataset(*_tables(w), _PANEL)),
         _PANEL_ENDS + user_feature_sql(14) + _BUYERS + _PANEL_OUT.format(label="b.user_id IS NOT NULL") + "LEFT JOIN buyers b ON b.user_id = f.user_id AND b.obs_end = f.obs_end")
register("G05_churn_label", lambda w: G.active_after(w.behaviors, w.orders, G.snapshot_ends(w.behaviors, _PANEL), 7, _PANEL.key_types),
         _PANEL_ENDS + _ALIVE + "SELECT user_id, CAST(obs_end AS VARCHAR) AS obs_end FROM alive")
register("G06_churn_dataset", lambda w: _rounded(G.churn_dataset(*_tables(w), _PANEL)),
         _PANEL_ENDS + user_feature_sql(14) + _ALIVE + _PANEL_OUT.format(label="b.user_id IS NULL")
         + "LEFT JOIN alive b ON b.user_id = f.user_id AND b.obs_end = f.obs_end WHERE f.total_behaviors > 0")
register("G07_time_split", lambda w: _split(w).groupBy("obs_end", "split").agg(
    F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives")),
    _PANEL_ENDS + _BUYERS + """
, k AS (SELECT obs_end, row_number() OVER (ORDER BY obs_end) AS p, (SELECT count(*) FROM ends) AS n FROM ends),
s AS (SELECT obs_end, CASE WHEN p <= n - round(n * 0.2) - greatest(1, round(n * 0.2)) THEN 'train' WHEN p <= n - greatest(1, round(n * 0.2)) THEN 'val' ELSE 'test' END AS split FROM k)
SELECT CAST(obs_end AS VARCHAR) AS obs_end, split, (SELECT count(*) FROM w_users) AS rows, count(user_id) AS positives FROM s LEFT JOIN buyers USING (obs_end) GROUP BY 1, 2""")


def _scored(w):
    """A score that SQL can repeat: the share of purchases among a user's behaviours."""
    d = G.purchase_dataset(*_tables(w), _PANEL)
    return d.select("obs_end", "user_id", "label", F.col("behavior_buy_ratio").alias("probability"))


_SCORED = _PANEL_ENDS + user_feature_sql(14) + _BUYERS + """
, scored AS (SELECT f.obs_end, f.user_id, CAST(b.user_id IS NOT NULL AS BIGINT) AS label, behavior_buy_ratio AS p
  FROM feat f LEFT JOIN buyers b ON b.user_id = f.user_id AND b.obs_end = f.obs_end),
sg AS (SELECT obs_end, p, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY 1, 2),
sc AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM sg WINDOW w AS (PARTITION BY obs_end ORDER BY p DESC))
"""
register("G10_classification_metrics", lambda w: M.classification_metrics(_scored(w), ("obs_end",), threshold=0.3), _SCORED + f"""
, t AS (SELECT obs_end, sum(pos) AS pp, sum(neg) AS nn, sum(pos) FILTER (p >= 0.3) AS tp, sum(neg) FILTER (p >= 0.3) AS fp,
   sum(neg * (cp - pos / 2.0)) AS pa, sum(pos * (cp / (cp + cn))) AS ap FROM sc GROUP BY 1)
SELECT CAST(obs_end AS VARCHAR) AS obs_end, CAST(pp + nn AS BIGINT) AS n_samples, CAST(pp AS BIGINT) AS n_positive, {sd('pp', 'pp + nn')} AS positive_rate,
 {sd('tp + nn - fp', 'pp + nn')} AS accuracy, {sd('tp', 'tp + fp')} AS precision, {sd('tp', 'pp')} AS recall, {sd('2 * tp', '2 * tp + fp + pp - tp')} AS f1,
 {rnd('pa / (CAST(pp AS DOUBLE) * nn)', 4)} AS roc_auc, {rnd('ap / pp', 4)} AS pr_auc,
 CAST(nn - fp AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(pp - tp AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp FROM t""")
register("G13_risk_level", lambda w: _scored(w).select("user_id", "obs_end", M.risk_level(F.col("probability"), 0.1, 0.4).alias("risk_level")),
         _SCORED + "SELECT user_id, CAST(obs_end AS VARCHAR) AS obs_end, CASE WHEN p < 0.1 THEN 'low' WHEN p > 0.4 THEN 'high' ELSE 'medium' END AS risk_level FROM scored")
register("G15_latest_per_user", lambda w: M.latest_per_user(_scored(w)), _SCORED + """
SELECT user_id, CAST(obs_end AS VARCHAR) AS obs_end, label, p AS probability FROM scored QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY obs_end DESC) = 1""")

_FULL = ModelSettings()  # the documented models, uncut


def _split(w):
    return G.time_split(G.purchase_dataset(*_tables(w), _PANEL), days=G.snapshot_ends(w.behaviors, _PANEL))


def _churn_split(w):
    return G.time_split(G.churn_dataset(*_tables(w), _PANEL), days=G.snapshot_ends(w.behaviors, _PANEL))


def _churn_scores(w):
    split = cut_lineage(_churn_split(w))
    models = M.fit_models(split.filter("split = 'train'"), _FULL, only="logistic_regression")
    return M.score_latest_snapshot(models["logistic_regression"], split)


def _purchase_scores(w):
    split = cut_lineage(_split(w))
    models = M.fit_models(split.filter("split = 'train'"), _FULL, only="logistic_regression")
    return M.score_latest_per_user(models["logistic_regression"], split)


register("G08_G09_model_metrics", lambda w: M.train_and_evaluate(_split(w), _FULL)[1])
register("G11_train_churn", lambda w: M.train_and_evaluate(_churn_split(w), _FULL)[1])
register("G12_feature_importance", lambda w: M.train_and_evaluate(_split(w), _FULL)[2])


def _model_round_trip(w):
    """Scores of a model that was saved and loaded again."""
    split = cut_lineage(_split(w))
    folder = scratch_path(split.sparkSession, "models")
    save_models(M.fit_models(split.filter("split = 'train'"), _FULL, only="logistic_regression"), folder)
    return M.score_latest_per_user(load_model(folder, "logistic_regression"), split)


register("A11_model_round_trip", _model_round_trip)
register("G14_churn_scores", _churn_scores)
register("G15_purchase_scores", _purchase_scores)
register("G16_best_model", lambda w: M.best_model(M.train_and_evaluate(_split(w), _FULL)[1]))
register("E14_segmentation_features", lambda w: M.segmentation_features(w.behaviors, w.orders), f"""
, a AS (SELECT user_id, {counts()}, max(event_date) AS l FROM behaviors GROUP BY 1),
p AS (SELECT user_id, count(*) AS purchase_frequency, round(sum(total_amount), 2) AS total_amount FROM w_orders WHERE status = 'paid' GROUP BY 1),
j AS (SELECT user_id, pv AS total_pv, click AS total_click, buy AS total_buy, coalesce(total_amount, 0.0) AS total_amount, {zeroed(['purchase_frequency'])},
  date_diff('day', l, (SELECT max(event_date) FROM behaviors)) AS recency FROM a LEFT JOIN p USING (user_id))
SELECT *, {sd('total_amount', 'purchase_frequency')} AS avg_order_amount FROM j""")
register("E15_user_segments", lambda w: M.assign_clusters(M.segmentation_features(w.behaviors, w.orders)).select("user_id", "cluster_id"))
register("E16_cluster_names", lambda w: M.name_clusters(M.segmentation_features(w.behaviors, w.orders).withColumn("cluster_id", F.col("user_id") % 4)), f"""
, a AS (SELECT user_id, {counts()}, max(event_date) AS l FROM behaviors GROUP BY 1),
p AS (SELECT user_id, count(*) AS purchase_frequency, round(sum(total_amount), 2) AS total_amount FROM w_orders WHERE status = 'paid' GROUP BY 1),
j AS (SELECT user_id % 4 AS cluster_id, pv AS total_pv, click AS total_click, buy AS total_buy, coalesce(total_amount, 0.0) AS total_amount,
  coalesce(purchase_frequency, 0) AS purchase_frequency, date_diff('day', l, (SELECT max(event_date) FROM behaviors)) AS recency FROM a LEFT JOIN p USING (user_id)),
m AS (SELECT cluster_id, count(*) AS size, {', '.join(f"{rnd(f'avg({c})', 4)} AS {c}" for c in ('total_pv', 'total_click', 'total_buy', 'total_amount', 'purchase_frequency'))},
  {rnd('avg(' + sd('total_amount', 'purchase_frequency') + ')', 4)} AS avg_order_amount, {rnd('avg(recency)', 1)} AS recency FROM j GROUP BY 1)
SELECT *, {sd('size', '(SELECT count(*) FROM j)')} AS ratio, CASE WHEN total_amount >= 5000 AND purchase_frequency >= 3 THEN '高价值活跃'
 WHEN total_amount >= 2000 AND total_pv >= 50 THEN '中价值潜力' WHEN recency <= 30 AND total_pv >= 30 THEN '活跃潜在' WHEN recency <= 60 THEN '低频沉睡' ELSE '流失风险' END AS cluster_name FROM m""")
