"""Registered queries: lookups and streaming indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as I
from ..operators import lookup as L
from ..operators import models as M
from ..operators import profiles as R
from ..operators.recommend import RECOMMENDERS
from ..plans.recommend import batch_recommendations
from ..session import cut_lineage, scratch_path
from ..streaming import indicators as S
from .basic import _GMV, _GRAINS, _PAID
from .cleaning import _add
from .deep import _ITEM_PROFILE, SESSION_SQL
from .panels import _FULL, _churn_split, _split
from .recommending import CFG, EVAL, HYBRID_SQL, _KNOWN, _active, base_sql, cf_sql, content_sql, global_topk_sql, personal_topk_sql
from .registry import register
from .sqltext import TYPES, sd


def _stamp(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


register("J01_user_search", lambda w: _stamp(L.search_users(w.users, "nation_1", 20, 5), "register_time"), """
, f AS (SELECT * FROM w_users WHERE regexp_matches(CAST(user_id AS VARCHAR), '(?i)nation_1') OR coalesce(regexp_matches(city, '(?i)nation_1'), FALSE))
SELECT * REPLACE (strftime(register_time, '%Y-%m-%d %H:%M:%S') AS register_time), (SELECT count(*) FROM f) AS total FROM f ORDER BY user_id LIMIT 20 OFFSET 5""")
register("J02_item_search", lambda w: _stamp(L.search_items(w.items, keyword="RING", brand="brand#1", on_shelf=True, sort="-price", limit=15), "created_at"), """
, f AS (SELECT * FROM w_items WHERE (regexp_matches(item_name, '(?i)RING') OR regexp_matches(CAST(item_id AS VARCHAR), '(?i)RING')) AND regexp_matches(brand, '(?i)brand#1') AND status = 1)
SELECT * REPLACE (strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at), (SELECT count(*) FROM f) AS total FROM f ORDER BY price DESC NULLS LAST, item_id LIMIT 15""")
register("J03_recent_behaviors", lambda w: L.recent_behaviors(w.behaviors, 20).select("user_id", "behavior_id", "behavior_type", "rank", "total"), """
, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, behavior_id DESC) AS rank, count(*) OVER (PARTITION BY user_id) AS total FROM behaviors)
SELECT user_id, behavior_id, behavior_type, rank, total FROM r WHERE rank <= 20""")
register("J04_order_history", lambda w: L.order_history(w.orders, w.order_items, w.items).select(
    "user_id", "order_id", "total_amount", "status", "item_id", "item_name", "quantity", "amount", "paid_orders", "paid_gmv"), """
, p AS (SELECT user_id, count(*) AS n, round(sum(total_amount), 2) AS g FROM w_orders WHERE status = 'paid' GROUP BY 1)
SELECT o.user_id, o.order_id, total_amount, o.status, l.item_id, item_name, quantity, amount, coalesce(n, 0) AS paid_orders, coalesce(g, 0.0) AS paid_gmv
FROM w_orders o LEFT JOIN w_lines l USING (order_id) LEFT JOIN w_items USING (item_id) LEFT JOIN p ON p.user_id = o.user_id""", "order")
register("J05_kpi_overview", lambda w: L.kpi_overview(w.users, w.behaviors, w.orders), _GRAINS + _PAID + f""", g AS ({_GMV.removeprefix(_PAID)}),
b AS (SELECT count(DISTINCT user_id) AS active_users, count(DISTINCT CASE WHEN behavior_type = 'buy' THEN user_id END) AS buying_users FROM behaviors),
la AS (SELECT grain, arg_max(value, bucket) AS v FROM t GROUP BY 1)
SELECT (SELECT count(*) FROM w_users) AS total_users, b.active_users, b.buying_users, {sd('b.buying_users', 'b.active_users')} AS pay_rate, gmv_total, order_count, aov, arpu, paid_rate,
 (SELECT v FROM la WHERE grain = 'dau') AS dau, (SELECT v FROM la WHERE grain = 'wau') AS wau, (SELECT v FROM la WHERE grain = 'mau') AS mau FROM b, g""")


def _profiles_with_scores(w):
    purchase, churn = cut_lineage(_split(w)), cut_lineage(_churn_split(w))
    p_model = M.fit_models(purchase.filter("split = 'train'"), _FULL, only="logistic_regression")
    c_model = M.fit_models(churn.filter("split = 'train'"), _FULL, only="logistic_regression")
    profiles = R.user_profile(w.users, w.behaviors, w.orders, w.order_items, w.items)
    joined = L.profile_with_predictions(
        profiles, M.score_latest_per_user(p_model["logistic_regression"], purchase),
        M.score_latest_snapshot(c_model["logistic_regression"], churn))
    return joined.select("user_id", "behavior.*", "spending_power", "lifecycle_stage", "purchase_probability", "churn_probability", "risk_level")


register("J06_profile_with_predictions", _profiles_with_scores)
register("J07_item_details", lambda w: L.item_details(w.items, w.behaviors, w.order_items, w.orders).select(
    "item_id", "item_name", "price", "stock", "behavior.*", "sales.*", "lifecycle_stage", "price_band", "heat_score"),
    _ITEM_PROFILE.rsplit("SELECT pj.item_id", 1)[0] + ", prof AS (SELECT pj.item_id" + _ITEM_PROFILE.rsplit("SELECT pj.item_id", 1)[1] + f""")
SELECT i.item_id, i.item_name, i.price, i.stock, {', '.join('prof.' + t for t in TYPES)}, unique_users, conversion_rate, sold, orders, gmv, lifecycle_stage, price_band, heat_score
FROM w_items i LEFT JOIN prof USING (item_id)""")
register("J08_lists_side_by_side", lambda w: L.lists_side_by_side(
    batch_recommendations(w.behaviors, w.items, w.orders, w.order_items, _active(w), CFG), tuple(RECOMMENDERS)),
    base_sql() + cf_sql() + content_sql() + HYBRID_SQL + ", every AS (" + " UNION ALL ".join(f"SELECT '{n}' AS algorithm, * FROM ({q})" for n, q in {
        "popular": global_topk_sql("pop", _KNOWN), "itemcf": personal_topk_sql("icf"), "usercf": personal_topk_sql("ucf"),
        "content": personal_topk_sql("con"), "hybrid": personal_topk_sql("hyb")}.items()) + ") SELECT user_id, rank, "
    + ", ".join(f"max(CASE WHEN algorithm = '{a}' THEN item_id END) AS {a}" for a in RECOMMENDERS) + " FROM every GROUP BY 1, 2")


def _metrics(w):
    purchase = M.train_and_evaluate(_split(w), _FULL)[1]
    churn = M.train_and_evaluate(_churn_split(w), _FULL)[1]
    ranking = I.compare_algorithms(w.behaviors, w.items, w.orders, w.order_items, EVAL)
    return L.metric_summary({"purchase": purchase, "churn": churn}, ranking)


register("J09_metric_summary", _metrics)

# ---- streams ---------------------------------------------------------------------------------


def _events(spark, d):
    return S.event_stream(spark, d, "events.parquet")


def _closed(cond: str, end: str) -> str:
    """Windows the watermark has closed once all events are in."""
    return f"{end} <= (SELECT max(ts) FROM events WHERE {cond}) - INTERVAL 2 HOUR"


_add("K01_stream_page_views", lambda s, d: _stamp(S.run_available(S.page_views(S.behavior_stream(_events(s, d)))), "window_start", "window_end"), f"""
WITH w AS (SELECT date_trunc('hour', ts) AS a, count(*) AS pv FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT strftime(a, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(a + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, pv FROM w
WHERE {_closed("event_type = 'view'", 'a + INTERVAL 1 HOUR')}""")
_add("K02_stream_active_users", lambda s, d: _stamp(S.run_available(S.active_users(S.behavior_stream(_events(s, d)))), "window_start", "window_end"), f"""
WITH h AS (SELECT date_trunc('hour', ts) + CASE WHEN extract('minute' FROM ts) >= 30 THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END AS a, user_id FROM events),
w AS (SELECT a, user_id FROM h UNION ALL SELECT a - INTERVAL 30 MINUTE, user_id FROM h)
SELECT strftime(a, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(a + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
 count(DISTINCT user_id) AS active_users FROM w WHERE {_closed('TRUE', 'a + INTERVAL 1 HOUR')} GROUP BY a""")
_add("K03_stream_hot_items", lambda s, d: _stamp(S.run_top_items(S.item_heat(S.behavior_stream(_events(s, d)))), "window_start"), f"""
WITH h AS (SELECT date_trunc('day', ts) AS a, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item_id,
  sum(CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 WHEN 'purchase' THEN 5.0 ELSE 0.0 END)::DOUBLE AS heat FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY heat DESC, item_id) AS rank FROM h WHERE {_closed('TRUE', 'a + INTERVAL 1 DAY')})
SELECT strftime(a, '%Y-%m-%d %H:%M:%S') AS window_start, item_id, heat, rank FROM r WHERE rank <= 10""")
_add("K04_stream_order_totals", lambda s, d: _stamp(S.run_available(S.order_totals(S.order_stream(_events(s, d)))), "window_start", "window_end"), f"""
WITH w AS (SELECT date_trunc('hour', ts) AS a, count(*) AS orders, round(sum(value), 2) AS gmv FROM events WHERE event_type = 'purchase' AND event_id % 10 < 8 GROUP BY 1)
SELECT strftime(a, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(a + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, orders, gmv FROM w
WHERE {_closed("event_type = 'purchase' AND event_id % 10 < 8", 'a + INTERVAL 1 HOUR')}""")
register("K05_stream_sessions_batch_twin", lambda w: _stamp(w.behaviors.groupBy("user_id", F.session_window("event_time", "30 minutes").alias("s")).agg(
    F.count(F.lit(1)).alias("events")).select("user_id", F.col("s.start").alias("session_start"), "events"), "session_start"),
    SESSION_SQL + "SELECT user_id, strftime(session_start, '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM sess GROUP BY user_id, sess.session_start")
_add("K05_stream_sessions", lambda s, d: _stamp(S.run_available(S.user_sessions(S.behavior_stream(_events(s, d)))), "session_start"), f"""
WITH l AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
f AS (SELECT *, max(CASE WHEN p IS NULL OR ts - p > INTERVAL 30 MINUTE THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM l)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM f GROUP BY user_id, a
HAVING {_closed('TRUE', 'max(ts) + INTERVAL 30 MINUTE')}""")
_add("K06_stream_deduplicated", lambda s, d: S.run_available(S.deduplicated(S.behavior_stream(_events(s, d)))).select("behavior_id", "user_id", "behavior_type"), """
SELECT event_id AS behavior_id, user_id, CASE event_type WHEN 'view' THEN 'pv' WHEN 'purchase' THEN 'buy' ELSE event_type END AS behavior_type FROM events""")


def _late(spark, d):
    """All events first; then every seventh one again, under a new id, of which those behind the watermark are dropped."""
    folder, out, state = (scratch_path(spark, n) for n in ("arrivals", "unique", "state"))
    events = spark.read.parquet(f"{d}/events.parquet")
    events.write.parquet(folder)
    S.run_available(S.deduplicated(S.behavior_stream(S.event_stream(spark, folder, "part*.parquet"))), out, state)
    events.where("event_id % 7 = 0").withColumn("event_id", -F.col("event_id") - 1).write.mode("append").parquet(folder)
    rows, late = S.run_counting_late(S.deduplicated(S.behavior_stream(S.event_stream(spark, folder, "part*.parquet"))), out, state)
    return rows.agg(F.count(F.lit(1)).alias("kept")).withColumn("late", F.lit(late).cast("long"))


_add("K07_late_rows", _late, """WITH m AS (SELECT max(ts) - INTERVAL 2 HOUR AS w FROM events)
SELECT count(*) + count(*) FILTER (event_id % 7 = 0 AND ts > w) AS kept, count(*) FILTER (event_id % 7 = 0 AND ts <= w) AS late FROM events, m""")
