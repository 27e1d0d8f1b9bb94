"""Registered query: the findings over fourteen results.  Comes last, since its check SQL holds other check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activity as A
from ..operators import baskets as B
from ..operators import catalogue as K
from ..operators import models as M
from ..operators import paths as P
from ..operators import profiles as R
from ..operators import retention as N
from ..operators import revenue as V
from ..operators import value as U
from ..plans.analysis import LARGE, run_analysis
from ..plans.features import run_features
from ..session import scratch_path
from ..settings import BasketSettings
from ..sources.worlds import event_world, order_world
from .basic import LIFE_SQL, RFM_SQL
from .deep import PRICE_SQL, SESSION_SQL, _bins, _life
from .registry import ENTRIES, Entry, portable
from .sqltext import counts, sd
from .worlds_sql import EVENT_HEAD


def _findings(spark, sf_dir):
    """Baskets come from the order tables: an order of the event table has one line."""
    w, shop = event_world(spark, sf_dir), order_world(spark, sf_dir)
    cohorts = N.cohort_analysis(w.behaviors)
    clusters = M.segmentation_features(w.behaviors, w.orders).withColumn("cluster_id", F.col("user_id") % 4)
    return R.findings({
        "user_scale": A.user_scale(w.users, w.behaviors), "funnel": A.conversion_funnel(w.behaviors),
        "retention": N.retention_overall(cohorts), "cohort_aggregate": N.cohort_aggregate(cohorts),
        "rfm_segments": U.rfm_segments(U.rfm(w.orders)),
        "lifecycle": U.lifecycle_distribution(U.user_lifecycle(w.users, w.behaviors, w.orders)),
        "top_paths": P.top_paths(w.behaviors, top_n=1),
        "item_ranking": V.item_ranking(w.items, w.behaviors, w.order_items, w.orders, 1),
        "item_stages": K.item_stage_distribution(_life(w)), "price_bins": _bins(w),
        "channels": K.channel_analysis(w.users, w.behaviors, w.orders), "devices": K.device_analysis(w.behaviors, w.orders),
        "item_rules": B.item_rules(shop.order_items, shop.orders, shop.items, BasketSettings(min_support=0.0002)),
        "segment_names": M.name_clusters(clusters)})


def _own(name: str) -> str:
    return f"({ENTRIES[name].sql})"


_SQL = EVENT_HEAD + RFM_SQL + LIFE_SQL + SESSION_SQL + PRICE_SQL + f"""
, fc AS (SELECT {counts()} FROM behaviors),
ch AS (SELECT channel, {sd("count(*) FILTER (behavior_type = 'buy')", "count(*) FILTER (behavior_type = 'pv')")} AS r FROM behaviors GROUP BY 1),
ic AS (SELECT item_id, {counts()} FROM behaviors GROUP BY 1),
ig AS (SELECT item_id, sum(amount) AS gmv FROM w_lines WHERE order_id IN (SELECT order_id FROM w_orders WHERE status = 'paid') GROUP BY 1),
ih AS (SELECT i.item_id, item_name, round(coalesce(pv + 2*click + 3*collect + 4*cart + 5*buy, 0) + coalesce(gmv, 0.0) / 100.0, 6) AS h
       FROM w_items i LEFT JOIN ic USING (item_id) LEFT JOIN ig USING (item_id))
SELECT 'user_scale' AS domain, 'pay_rate' AS metric, 'all' AS label,
  {sd("count(DISTINCT CASE WHEN behavior_type = 'buy' THEN user_id END)", 'count(DISTINCT user_id)')} AS value FROM behaviors
UNION ALL SELECT 'funnel', 'step_conversion_rate', 'click', {sd('click', 'pv')} FROM fc
UNION ALL SELECT 'funnel', 'step_conversion_rate', 'collect', {sd('collect', 'click')} FROM fc
UNION ALL SELECT 'funnel', 'step_conversion_rate', 'cart', {sd('cart', 'collect')} FROM fc
UNION ALL SELECT 'funnel', 'step_conversion_rate', 'buy', {sd('buy', 'cart')} FROM fc
UNION ALL SELECT 'rfm', 'count', segment, count(*) FROM rfm GROUP BY segment
UNION ALL SELECT 'lifecycle', 'ratio', s.stage, {sd('count(user_id)', '(SELECT count(*) FROM life)')}
  FROM (SELECT unnest(['高价值用户','新用户','成长期','活跃用户','沉默用户','流失风险']) AS stage) s LEFT JOIN life USING (stage) GROUP BY s.stage
UNION ALL SELECT * FROM (SELECT 'purchase_path', 'sessions', path, sessions FROM ptable ORDER BY sessions DESC, path LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'item_ranking', 'heat_score', item_name, round(h, 2) FROM ih ORDER BY h DESC, item_id LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'price', 'buy_rate', CAST(bin AS VARCHAR), buy_rate FROM pbins ORDER BY buy_rate DESC, bin LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'channel', 'buy_rate', channel, r FROM ch ORDER BY r DESC, channel DESC LIMIT 1)
UNION ALL SELECT 'device', 'behavior_ratio', 'mobile', {sd("count(*) FILTER (device_type = 'mobile')", 'count(*)')} FROM behaviors""" + f"""
UNION ALL SELECT 'retention', 'rate', CAST("offset" AS VARCHAR), rate FROM {_own('D22_retention_overall')}
UNION ALL SELECT 'cohort', 'day_1', CAST(total_cohorts AS VARCHAR), day_1 FROM {_own('D21_cohort_aggregate')}
UNION ALL SELECT 'item_lifecycle', 'count', stage, "count" FROM {_own('E07_item_stages')}
UNION ALL SELECT * FROM (SELECT 'association', 'lift', antecedent || ' + ' || consequent, lift FROM {_own('E12_item_rules')}
  ORDER BY lift DESC, antecedent DESC, consequent DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'segmentation', 'size', cluster_name, size FROM {_own('E16_cluster_names')} ORDER BY size DESC, cluster_id DESC LIMIT 1)"""

ENTRIES["E19_findings"] = Entry(lambda spark, sf_dir: portable(_findings(spark, sf_dir)), _SQL)


def _counted_rows(**names) -> str:
    """Rows of each written table, by the SQL of the query that makes it."""
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM ({ENTRIES[n].sql})) AS rows" for t, n in names.items())


def _run(run, seen):
    """The rows that a whole run observed of the tables it wrote; ``seen`` finds them in the run's folder."""
    def made(spark, d):
        w = event_world(spark, d)
        out = scratch_path(spark, "run")
        run(spark, {"users": w.users, "items": w.items, "user_behaviors": w.behaviors, "orders": w.orders, "order_items": w.order_items}, out)
        return portable(seen(spark, out).select("table_name", "rows"))
    return made


ENTRIES["E20_run_records"] = Entry(
    lambda spark, d: _run(run_analysis, lambda s, out: s.read.json(f"{out}/run_record").selectExpr("inline(tables)"))(spark, d).filter(F.col("table_name").isin(*LARGE)),
    _counted_rows(rfm_users="D23_rfm", lifecycle_users="E01_user_lifecycle", item_lifecycle="E05_item_lifecycle", user_profile="E17_user_profile",
                  item_profile="E18_item_profile", user_segments="E14_segmentation_features", register_trend="D02_register_trend"))
ENTRIES["F05_run_records"] = Entry(_run(run_features, lambda s, out: s.read.json(f"{out}/table_records")), _counted_rows(
    user_features="F01_user_features", item_features="F02_item_features", user_item_features="F03_user_item_features"))
