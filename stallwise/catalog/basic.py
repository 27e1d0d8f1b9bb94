"""Registered queries: activity, revenue, ranking, retention and value."""

from __future__ import annotations

from ..operators import activity as A
from ..operators import retention as R
from ..operators import revenue as V
from ..operators import value as U
from ..settings import RETENTION_OFFSETS as OFF
from .registry import register
from .sqltext import TYPES, big, counts, day, days_between, elapsed, sd, zeroed

register("D01_user_scale", lambda w: A.user_scale(w.users, w.behaviors), f"""
, u AS (SELECT count(*) AS total_users, count(DISTINCT user_id) AS new_users FROM w_users),
b AS (SELECT count(DISTINCT user_id) AS active_users,
             count(DISTINCT CASE WHEN behavior_type = 'buy' THEN user_id END) AS buying_users FROM behaviors)
SELECT total_users, new_users, active_users, buying_users, {sd('buying_users', 'active_users')} AS pay_rate FROM u, b""")

register("D02_register_trend", lambda w: A.register_trend(w.users), f"""
SELECT {day('register_time')} AS date, count(*) AS count FROM w_users WHERE register_time IS NOT NULL GROUP BY 1""")

for _name, _col in (("D03_gender_distribution", "gender"), ("D03_city_distribution", "city")):
    register(_name, lambda w, c=_col: A.value_distribution(w.users, c), f"""
SELECT coalesce({_col}, '未知') AS label, count(*) AS count FROM w_users
WHERE EXISTS (SELECT 1 FROM w_users WHERE {_col} IS NOT NULL) GROUP BY 1""")

_GRAINS = """
, t AS (
 SELECT 'dau' AS grain, strftime(event_date, '%Y-%m-%d') AS bucket, count(DISTINCT user_id) AS value FROM behaviors GROUP BY 2
 UNION ALL SELECT 'wau', strftime(date_trunc('week', event_date), '%Y-%m-%d'), count(DISTINCT user_id) FROM behaviors GROUP BY 2
 UNION ALL SELECT 'mau', strftime(event_date, '%Y-%m'), count(DISTINCT user_id) FROM behaviors GROUP BY 2)
"""
for _name, _grain in (("D04_dau", "dau"), ("D05_wau", "wau"), ("D06_mau", "mau")):
    register(_name, lambda w, g=_grain: A.active_users(w.behaviors).filter(f"grain = '{g}'"),
             _GRAINS + f"SELECT * FROM t WHERE grain = '{_grain}'")
register("D07_latest_active", lambda w: A.latest_active_users(w.behaviors),
         _GRAINS + "SELECT grain, max(bucket) AS bucket, arg_max(value, bucket) AS value FROM t GROUP BY grain")

register("D08_behavior_summary", lambda w: A.behavior_summary(w.behaviors), f"""
, c AS (SELECT count(*) AS total, {counts()} FROM behaviors)
SELECT *, {', '.join(sd(t, 'pv') + f' AS {t}_rate' for t in TYPES[1:])} FROM c""")

register("D09_behavior_trend", lambda w: A.behavior_trend(w.behaviors), f"""
SELECT {day('event_date')} AS date, {counts()} FROM behaviors GROUP BY 1""")

register("D10_activity_by_hour", lambda w: A.activity_by_hour(w.behaviors), """
SELECT h.hour, count(*) FILTER (behavior_type = 'pv') AS pv, count(*) FILTER (behavior_type = 'buy') AS buy,
       count(behavior_id) AS total
FROM (SELECT unnest(range(24)) AS hour) h LEFT JOIN behaviors ON event_hour = h.hour GROUP BY 1""")

register("D11_activity_by_weekday", lambda w: A.activity_by_weekday(w.behaviors), """
SELECT d.weekday, count(behavior_id) AS count FROM (SELECT unnest(range(7)) AS weekday) d
LEFT JOIN behaviors ON isodow(event_date) - 1 = d.weekday GROUP BY 1""")

register("D12_activity_by_device_hour", lambda w: A.activity_by_device_hour(w.behaviors), """
SELECT d.device, h.hour, count(behavior_id) AS count
FROM (SELECT unnest(['mobile', 'pc', 'tablet']) AS device) d, (SELECT unnest(range(24)) AS hour) h
LEFT JOIN behaviors ON event_hour = h.hour AND device_type = d.device GROUP BY 1, 2""")

_PAID = ", paid AS (SELECT * FROM w_orders WHERE status = 'paid'), act AS (SELECT count(DISTINCT user_id) AS n FROM behaviors)"
_GMV = _PAID + f"""
SELECT coalesce(round(sum(total_amount), 2), 0.0) AS gmv_total, count(*) AS order_count,
       count(DISTINCT user_id) AS buying_users, any_value(n) AS active_users,
       {sd('round(sum(total_amount), 2)', 'count(*)')} AS aov, {sd('round(sum(total_amount), 2)', 'any_value(n)')} AS arpu,
       {sd('count(DISTINCT user_id)', 'any_value(n)')} AS paid_rate
FROM paid, act"""
_TREND = _PAID + "".join(f"""{' UNION ALL' if i else ''}
SELECT '{g}' AS grain, {label} AS bucket, round(sum(total_amount), 2) AS gmv, count(*) AS orders,
       count(DISTINCT user_id) AS buying_users, {sd('round(sum(total_amount), 2)', 'count(*)')} AS aov,
       {sd('round(sum(total_amount), 2)', 'any_value(n)')} AS arpu
FROM paid, act GROUP BY 2""" for i, (g, label) in enumerate((
    ("day", "strftime(order_time, '%Y-%m-%d')"),
    ("week", "strftime(date_trunc('week', order_time), '%Y-%m-%d')"),
    ("month", "strftime(order_time, '%Y-%m')"))))
_STATUS = """
SELECT s.status, count(order_id) AS count FROM (SELECT unnest(['paid', 'cancelled', 'refunded']) AS status) s
LEFT JOIN w_orders o ON o.status = s.status GROUP BY 1"""
for _world, _tag in (("event", ""), ("order", "_orders")):
    register(f"D13_gmv{_tag}", lambda w: V.gmv_summary(w.orders, w.behaviors), _GMV, _world)
    register(f"D14_gmv_trend{_tag}", lambda w: V.gmv_trend(w.orders, w.behaviors), _TREND, _world)
    register(f"D15_status_distribution{_tag}", lambda w: V.status_distribution(w.orders), _STATUS, _world)

_HEAT = "pv + 2 * click + 3 * collect + 4 * cart + 5 * buy"
_ITEM_RANK = f"""
, c AS (SELECT item_id, {counts()}, count(DISTINCT user_id) AS unique_users FROM behaviors GROUP BY 1),
g AS (SELECT item_id, sum(amount) AS gmv FROM w_lines WHERE order_id IN (SELECT order_id FROM w_orders WHERE status = 'paid') GROUP BY 1),
t AS (SELECT i.item_id, item_name, category_id, brand, price, status, {zeroed(TYPES)},
             coalesce(gmv, 0.0) AS g0, {zeroed(['unique_users'])}
      FROM w_items i LEFT JOIN c USING (item_id) LEFT JOIN g USING (item_id))
SELECT item_id, item_name, category_id, brand, round(price, 2) AS price, status, {', '.join(TYPES)}, round(g0, 2) AS gmv,
       unique_users, {sd('buy', 'pv')} AS conversion_rate, round(round({_HEAT} + g0 / 100.0, 6), 2) AS heat_score
FROM t ORDER BY round({_HEAT} + g0 / 100.0, 6) DESC, item_id LIMIT 10"""
_CATEGORY_RANK = f"""
, c AS (SELECT category_id, {counts()}, count(DISTINCT user_id) AS users FROM behaviors JOIN w_items USING (item_id) GROUP BY 1),
g AS (SELECT category_id, sum(amount) AS gmv, count(DISTINCT order_id) AS orders FROM w_lines
      JOIN (SELECT order_id FROM w_orders WHERE status = 'paid') USING (order_id) JOIN w_items USING (item_id) GROUP BY 1)
SELECT category_id, {zeroed(['users', *TYPES, 'orders'])}, round(coalesce(gmv, 0.0), 2) AS gmv,
       {sd('coalesce(buy, 0)', 'coalesce(pv, 0)')} AS conversion_rate
FROM (SELECT DISTINCT category_id FROM w_items WHERE category_id IS NOT NULL)
LEFT JOIN c USING (category_id) LEFT JOIN g USING (category_id) ORDER BY gmv DESC, category_id LIMIT 10"""
_BRAND_RANK = f"""
, b AS (SELECT brand, count(DISTINCT user_id) AS users FROM behaviors JOIN w_items USING (item_id) GROUP BY 1),
g AS (SELECT brand, sum(amount) AS gmv, sum(quantity) AS sold, count(DISTINCT o.user_id) AS buy_users,
             count(DISTINCT l.order_id) AS orders
      FROM w_lines l JOIN w_orders o ON l.order_id = o.order_id AND o.status = 'paid' JOIN w_items USING (item_id)
      WHERE brand IS NOT NULL GROUP BY 1)
SELECT brand, round(gmv, 2) AS gmv, CAST(sold AS DOUBLE) AS sold, buy_users, orders, {zeroed(['users'])},
       round({sd('round(gmv, 2)', 'orders')}, 2) AS aov
FROM g LEFT JOIN b USING (brand) ORDER BY gmv DESC, brand LIMIT 10"""
for _world, _tag in (("event", ""), ("order", "_orders")):
    register(f"D16_item_ranking{_tag}",
             lambda w: V.item_ranking(w.items, w.behaviors, w.order_items, w.orders), _ITEM_RANK, _world)
    register(f"D17_category_ranking{_tag}",
             lambda w: V.category_ranking(w.items, w.behaviors, w.order_items, w.orders), _CATEGORY_RANK, _world)
    register(f"D18_brand_ranking{_tag}",
             lambda w: V.brand_ranking(w.items, w.behaviors, w.order_items, w.orders), _BRAND_RANK, _world)

register("D19_conversion_funnel", lambda w: A.conversion_funnel(w.behaviors), f"""
, c AS (SELECT s.step, s.stage, count(behavior_id) AS count
        FROM (SELECT unnest([1,2,3,4,5]) AS step, unnest({list(TYPES)}) AS stage) s
        LEFT JOIN behaviors ON behavior_type = s.stage GROUP BY 1, 2)
SELECT step, stage, count,
       CASE WHEN step = 1 THEN 1.0 ELSE {sd('count', 'lag(count) OVER (ORDER BY step)')} END AS step_conversion_rate,
       {sd('count', 'first_value(count) OVER (ORDER BY step)')} AS overall_conversion_rate FROM c""")


def _cohort_sql(start: str) -> str:
    return f"""
, start AS ({start}),
days AS (SELECT DISTINCT user_id, event_date FROM behaviors),
co AS (SELECT cohort_date, count(DISTINCT s.user_id) AS size, count(DISTINCT s.user_id) AS day_0,
  {', '.join(f"count(DISTINCT CASE WHEN event_date = cohort_date + {d} THEN s.user_id END) AS day_{d}" for d in OFF)}
  FROM start s LEFT JOIN days USING (user_id) GROUP BY 1)
"""


_FIRST = _cohort_sql("SELECT user_id, min(event_date) AS cohort_date FROM behaviors GROUP BY 1")
_REGISTER = _cohort_sql("SELECT user_id, CAST(min(register_time) AS DATE) AS cohort_date FROM w_users GROUP BY 1")
_COHORT_OUT = f"""SELECT CAST(cohort_date AS VARCHAR) AS cohort_date, size, day_0, {', '.join(f'day_{d}' for d in OFF)},
 {', '.join(sd(f'day_{d}', 'day_0') + f' AS rate_day_{d}' for d in OFF)} FROM co"""
register("D20_cohort_first_behavior", lambda w: R.cohort_analysis(w.behaviors), _FIRST + _COHORT_OUT)
register("D20_cohort_register", lambda w: R.cohort_analysis(w.behaviors, w.users, base="register"),
         _REGISTER + _COHORT_OUT)
register("D21_cohort_aggregate", lambda w: R.cohort_aggregate(R.cohort_analysis(w.behaviors)), _FIRST + f"""
SELECT count(*) AS total_cohorts, CAST(sum(day_0) AS BIGINT) AS total_users,
       {', '.join(sd(f'sum(day_{d})', 'sum(day_0)') + f' AS day_{d}' for d in OFF)} FROM co""")
register("D22_retention_overall", lambda w: R.retention_overall(R.cohort_analysis(w.behaviors)),
         _FIRST + " UNION ALL ".join(f"""SELECT {d} AS "offset", {big(f'sum(day_{d})')} AS retained, {big('sum(size)')} AS base,
 {sd(f'sum(day_{d})', 'sum(size)')} AS rate FROM co""" for d in OFF))
register("D22_retention_by_cohort", lambda w: R.retention_by_cohort(R.cohort_analysis(w.behaviors)),
         _FIRST + " UNION ALL ".join(
             f"""SELECT CAST(cohort_date AS VARCHAR) AS cohort_date, size, {d} AS "offset", {sd(f'day_{d}', 'size')} AS rate FROM co"""
             for d in OFF))

RFM_SQL = f"""
, rp AS (SELECT * FROM w_orders WHERE status = 'paid'),
ra AS (SELECT max(order_time) AS as_of FROM rp),
rm AS (SELECT user_id, max(order_time) AS last_time,
         count(*) FILTER (order_time >= as_of - INTERVAL 90 DAY) AS purchase_count,
         coalesce(sum(total_amount) FILTER (order_time >= as_of - INTERVAL 90 DAY), 0.0) AS amount, any_value(as_of) AS as_of
       FROM rp, ra GROUP BY 1),
rs AS (SELECT user_id, {elapsed('as_of', 'last_time')} AS recency_days, purchase_count, amount FROM rm),
rsc AS (SELECT *, CASE WHEN recency_days < 30 THEN 5 WHEN recency_days < 60 THEN 4 WHEN recency_days < 90 THEN 3
                       WHEN recency_days < 120 THEN 2 ELSE 1 END AS r_score,
   CASE WHEN purchase_count >= 8 THEN 5 WHEN purchase_count >= 4 THEN 4 WHEN purchase_count >= 2 THEN 3
        WHEN purchase_count >= 1 THEN 2 ELSE 1 END AS f_score,
   CASE WHEN amount >= 8000 THEN 5 WHEN amount >= 3000 THEN 4 WHEN amount >= 1000 THEN 3 WHEN amount >= 500 THEN 2 ELSE 1 END AS m_score
 FROM rs),
rfm AS (SELECT user_id, recency_days, purchase_count, round(amount, 2) AS total_amount, r_score, f_score, m_score,
   r_score * 100 + f_score * 10 + m_score AS rfm_score, r_score + f_score + m_score AS rfm_total,
   CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN '高价值'
        WHEN r_score >= 4 AND f_score >= 3 AND m_score >= 3 THEN '重要保持'
        WHEN r_score >= 4 AND f_score >= 2 AND m_score >= 2 THEN '潜力'
        WHEN r_score >= 3 AND f_score >= 2 AND m_score >= 2 THEN '一般'
        WHEN r_score = 2 AND f_score >= 2 THEN '沉睡' ELSE '流失风险' END AS segment FROM rsc)
"""
_RFM_SEG = RFM_SQL + f"""SELECT segment, count(*) AS count, round(sum(total_amount), 2) AS gmv,
 {sd('count(*)', '(SELECT count(*) FROM rfm)')} AS ratio FROM rfm GROUP BY 1"""
_RFM_DIST = RFM_SQL + """, u AS (SELECT 'r_score' AS dimension, r_score AS score FROM rfm UNION ALL SELECT 'f_score', f_score FROM rfm
 UNION ALL SELECT 'm_score', m_score FROM rfm)
SELECT d.dimension, s.score, count(u.score) AS count
FROM (SELECT unnest(['r_score', 'f_score', 'm_score']) AS dimension) d, (SELECT unnest([1, 2, 3, 4, 5]) AS score) s
LEFT JOIN u ON u.dimension = d.dimension AND u.score = s.score GROUP BY 1, 2"""
for _world, _tag in (("event", ""), ("order", "_orders")):
    register(f"D23_rfm{_tag}", lambda w: U.rfm(w.orders), RFM_SQL + "SELECT * FROM rfm", _world)
    register(f"D24_rfm_segments{_tag}", lambda w: U.rfm_segments(U.rfm(w.orders)), _RFM_SEG, _world)
    register(f"D25_rfm_scores{_tag}", lambda w: U.rfm_score_distribution(U.rfm(w.orders)), _RFM_DIST, _world)

LIFE_SQL = f"""
, la AS (SELECT user_id, max(event_date) AS last_active FROM behaviors GROUP BY 1),
lo AS (SELECT user_id, count(*) AS purchase_count, sum(total_amount) AS total_amount FROM w_orders WHERE status = 'paid' GROUP BY 1),
lm AS (SELECT max(event_date) AS as_of FROM behaviors),
lb AS (SELECT u.user_id, {days_between('as_of', 'register_time')} AS register_days,
   coalesce({days_between('as_of', 'last_active')}, 1000000000) AS recency_days,
   coalesce(purchase_count, 0) AS purchase_count, coalesce(total_amount, 0.0) AS amount
  FROM w_users u LEFT JOIN la USING (user_id) LEFT JOIN lo USING (user_id), lm),
life AS (SELECT user_id, register_days, recency_days, purchase_count, round(amount, 2) AS total_amount,
   CASE WHEN recency_days <= 7 AND amount >= 5000 THEN '高价值用户' WHEN register_days <= 7 THEN '新用户'
        WHEN register_days <= 30 AND purchase_count >= 1 THEN '成长期' WHEN recency_days <= 7 THEN '活跃用户'
        WHEN recency_days <= 30 THEN '沉默用户' ELSE '流失风险' END AS stage FROM lb)
"""
_LIFE_DIST = LIFE_SQL + f"""SELECT s.stage, count(user_id) AS count, {sd('count(user_id)', '(SELECT count(*) FROM life)')} AS ratio,
 round(coalesce(sum(total_amount), 0.0), 2) AS gmv, {sd('round(sum(total_amount), 2)', 'count(user_id)')} AS avg_amount
FROM (SELECT unnest(['高价值用户','新用户','成长期','活跃用户','沉默用户','流失风险']) AS stage) s LEFT JOIN life USING (stage) GROUP BY 1"""
for _world, _tag in (("event", ""), ("order", "_orders")):
    register(f"E01_user_lifecycle{_tag}", lambda w: U.user_lifecycle(w.users, w.behaviors, w.orders),
             LIFE_SQL + "SELECT * FROM life", _world)
    register(f"E02_lifecycle_distribution{_tag}",
             lambda w: U.lifecycle_distribution(U.user_lifecycle(w.users, w.behaviors, w.orders)), _LIFE_DIST, _world)
