"""Registered queries: building blocks, paths, item lifecycle, prices, channels, baskets and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as E
from ..operators import activity as A
from ..operators import baskets as B
from ..operators import catalogue as K
from ..operators import paths as P
from ..operators import profiles as R
from ..operators import revenue as V
from ..operators import value as U
from ..operators.features import observation_window
from ..settings import BEHAVIOR_WEIGHTS, BasketSettings, ItemLifeSettings, parse_weights
from .basic import LIFE_SQL, RFM_SQL
from .registry import register
from .sqltext import TYPES, counts, elapsed, rnd, sd, zeroed

_T = ", ".join(TYPES)

# ---- building blocks -------------------------------------------------------------------------
_BY_USER = f", c AS (SELECT user_id, {counts()} FROM behaviors GROUP BY 1)"
_BY_ITEM = f", c AS (SELECT item_id, {counts()} FROM behaviors GROUP BY 1), s AS (SELECT item_id, CAST(pv + 2*click + 3*collect + 4*cart + 5*buy AS DOUBLE) AS score FROM c)"


def _user_counts(w):
    return w.behaviors.groupBy("user_id").agg(*E.type_counts())


def _item_scores(w):
    by_item = w.behaviors.groupBy("item_id").agg(*E.type_counts())
    return by_item.select("item_id", E.weighted_counts(BEHAVIOR_WEIGHTS).alias("score"))


register("C01_safe_div", lambda w: _user_counts(w).select("user_id", E.safe_div("buy", "pv").alias("rate"), E.safe_div("cart", "collect").alias("none")),
         _BY_USER + f" SELECT user_id, {sd('buy', 'pv')} AS rate, {sd('cart', 'collect')} AS none FROM c")


def _decay(w):
    ref = E.scalar_row(w.behaviors, d=F.max("event_date"))["d"]
    return w.behaviors.select("behavior_id", F.round(E.time_decay(ref, "event_date", 7.0), 6).alias("decay"),
                              E.time_decay(ref, "event_date", 0).alias("flat"))


register("C02_time_decay", _decay, """
SELECT behavior_id, round(power(0.5, date_diff('day', event_date, (SELECT max(event_date) FROM behaviors)) / 7.0), 6) AS decay, 1.0 AS flat FROM behaviors""")


def _scaled(w):
    scores = _item_scores(w)
    r = E.scalar_row(scores, low=F.min("score"), high=F.max("score"))
    return scores.select("item_id", F.round(E.min_max("score", r["low"], r["high"]), 6).alias("scaled"))


register("C03_min_max", _scaled, _BY_ITEM + """
SELECT item_id, round((score - (SELECT min(score) FROM s)) / ((SELECT max(score) FROM s) - (SELECT min(score) FROM s)), 6) AS scaled FROM s""")


def _max_scaled(w):
    scores = _item_scores(w)
    high = E.scalar_row(scores, high=F.max("score"))["high"]
    return scores.select("item_id", F.round(E.by_maximum("score", high), 6).alias("scaled"))


register("C04_max_normalise", _max_scaled, _BY_ITEM + "SELECT item_id, round(score / (SELECT max(score) FROM s), 6) AS scaled FROM s")
register("C05_count_matrix", _user_counts, f"SELECT user_id, {counts()} FROM behaviors GROUP BY 1")


def _window(w):
    start, end = observation_window(w.behaviors, 30)
    return w.behaviors.agg(F.count_if(F.col("event_date").between(start, end)).alias("rows")).select(
        start.cast("string").alias("obs_start"), end.cast("string").alias("obs_end"), "rows")


register("C06_observation_window", _window, """
, m AS (SELECT max(event_date) AS e FROM behaviors)
SELECT CAST(CAST(e - INTERVAL 29 DAY AS DATE) AS VARCHAR) AS obs_start, CAST(e AS VARCHAR) AS obs_end,
 (SELECT count(*) FROM behaviors, m WHERE event_date BETWEEN e - INTERVAL 29 DAY AND e) AS rows FROM m""")

SESSION_SQL = """
, lagged AS (SELECT *, lag(event_time) OVER u AS pt, lag(behavior_type) OVER u AS ptype FROM behaviors
             WINDOW u AS (PARTITION BY user_id ORDER BY event_time, behavior_id)),
flagged AS (SELECT *, pt IS NULL OR event_time - pt > INTERVAL 30 MINUTE AS new_session FROM lagged),
sess AS (SELECT *, max(CASE WHEN new_session THEN event_time END) OVER (PARTITION BY user_id ORDER BY event_time, behavior_id) AS session_start
         FROM flagged),
steps AS (SELECT * FROM sess WHERE new_session OR ptype <> behavior_type),
paths AS (SELECT user_id, session_start, string_agg(behavior_type, '→' ORDER BY event_time, behavior_id) AS path, count(*) AS tokens,
                 max(CASE WHEN behavior_type = 'buy' THEN 1 ELSE 0 END) AS buy FROM steps GROUP BY 1, 2),
ptable AS (SELECT path, count(*) AS sessions, count(DISTINCT user_id) AS users, CAST(sum(buy) AS BIGINT) AS buy_sessions FROM paths GROUP BY 1)
"""
register("C07_sessions", lambda w: P.session_starts(w.behaviors).select(
    "behavior_id", "new_session", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start")),
    SESSION_SQL + "SELECT behavior_id, CAST(new_session AS BIGINT) AS new_session, strftime(session_start, '%Y-%m-%d %H:%M:%S') AS session_start FROM sess")
register("C08_collapse_repeats", lambda w: P.collapsed_steps(w.behaviors).select("behavior_id", "behavior_type"),
         SESSION_SQL + "SELECT behavior_id, behavior_type FROM steps")


def _daily_slope(w):
    days = w.behaviors.groupBy("item_id", "event_date").agg(F.count(F.lit(1)).alias("n"))
    series = days.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("event_date", "n"))).alias("s"))
    return series.select("item_id", F.round(K.trend_slope(F.transform("s", lambda x: x["n"])), 4).alias("slope"))


register("C09_trend_slope", _daily_slope, f"""
, d AS (SELECT item_id, event_date, count(*) AS n FROM behaviors GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY event_date) - 1 AS x FROM d)
SELECT item_id, coalesce({rnd('regr_slope(n, x)', 4)}, 0.0) AS slope FROM i GROUP BY 1""")


def bins_sql(n: int, name: str = "binned") -> str:
    probs = ", ".join(repr(i / n) for i in range(n + 1))
    return f"""
, q AS (SELECT quantile_cont(CAST(price AS DOUBLE), [{probs}]) AS e FROM w_items),
edges AS (SELECT list_sort(list_distinct(e)) AS e FROM q),
{name} AS (SELECT item_id, price, least(len(list_filter(e[2:], lambda x: x < CAST(price AS DOUBLE))), len(e) - 2) AS bin, e FROM w_items, edges)
"""


register("C10_quantile_bins", lambda w: K.binned_items(w.items, 4).select("item_id", "bin"), bins_sql(4) + "SELECT item_id, bin FROM binned")
register("C12_bucket_score", lambda w: w.orders.select(
    "order_id", E.bin_score_high("total_amount", (50000, 100000, 200000, 400000)).alias("high"),
    E.bin_score_low(F.col("total_amount"), (50000, 100000, 200000, 400000)).alias("low")), """
SELECT order_id, 1 + (total_amount >= 50000)::INT + (total_amount >= 100000)::INT + (total_amount >= 200000)::INT + (total_amount >= 400000)::INT AS high,
 CASE WHEN total_amount < 50000 THEN 5 WHEN total_amount < 100000 THEN 4 WHEN total_amount < 200000 THEN 3 WHEN total_amount < 400000 THEN 2 ELSE 1 END AS low
FROM w_orders""", "order")
register("C13_rule_chain", lambda w: U.rfm(w.orders).groupBy("r_score", "f_score", "m_score", "segment").agg(F.count(F.lit(1)).alias("n")),
         RFM_SQL + "SELECT r_score, f_score, m_score, segment, count(*) AS n FROM rfm GROUP BY ALL", "order")

_TIER = "CASE WHEN gmv >= 10000 THEN '超高消费' WHEN gmv >= 3000 THEN '高消费' WHEN gmv >= 1000 THEN '中消费' WHEN gmv > 0 THEN '低消费' ELSE '未消费' END"
register("C14_spend_tier", lambda w: V.paid_orders(w.orders).groupBy("user_id").agg(E.cents(F.sum("total_amount")).alias("gmv"))
         .select("user_id", "gmv", R.spend_tier(F.col("gmv")).alias("tier")),
         f", g AS (SELECT user_id, round(sum(total_amount), 2) AS gmv FROM w_orders WHERE status = 'paid' GROUP BY 1) SELECT user_id, gmv, {_TIER} AS tier FROM g")
_MODES = {"hour": "event_hour", "channel": "channel", "device": "device_type"}
for _n, _c in _MODES.items():
    register(f"C16_mode_{_n}", lambda w, c=_c: R.group_mode(w.behaviors, "user_id", F.col(c), "value"), f"""
, n AS (SELECT user_id, {_c} AS value, count(*) AS n FROM behaviors GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, value) AS k FROM n) SELECT user_id, value FROM r WHERE k = 1""")
for _c in ("category_id", "brand"):
    register(f"C17_top_{_c}", lambda w, c=_c: R.preferences(w.behaviors, w.items, c), f"""
, n AS (SELECT user_id, {_c}, count(*) AS count FROM behaviors JOIN w_items USING (item_id) WHERE {_c} IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY count DESC, {_c}) AS rank FROM n) SELECT * FROM r WHERE rank <= 3""")
register("C18_weights_argument", lambda w: w.behaviors.groupBy("item_id").agg(
    F.sum(E.weight_of("behavior_type", parse_weights("pv:1,click:2.5,buy:6"))).alias("score")), """
SELECT item_id, sum(CASE behavior_type WHEN 'pv' THEN 1.0 WHEN 'click' THEN 2.5 WHEN 'buy' THEN 6.0 ELSE 0.0 END)::DOUBLE AS score FROM behaviors GROUP BY 1""")

register("C18_default_weights", lambda w: w.behaviors.groupBy("item_id").agg(
    F.sum(E.weight_of("behavior_type", parse_weights(""))).alias("score")), f"""
SELECT item_id, sum(CASE behavior_type {' '.join(f"WHEN '{t}' THEN {float(x)}" for t, x in BEHAVIOR_WEIGHTS.items())} ELSE 0.0 END)::DOUBLE AS score
FROM behaviors GROUP BY 1""")

# ---- paths -----------------------------------------------------------------------------------
register("E03_top_paths", lambda w: P.top_paths(w.behaviors), SESSION_SQL + f"""
SELECT *, {sd('buy_sessions', 'sessions')} AS final_buy_rate FROM ptable ORDER BY sessions DESC, path LIMIT 10""")
register("E03_path_table", lambda w: P.path_table(P.session_paths(w.behaviors)), SESSION_SQL + f"""
SELECT *, {sd('buy_sessions', 'sessions')} AS final_buy_rate FROM ptable""")
register("E04_path_totals", lambda w: P.path_totals(w.behaviors), SESSION_SQL + """
, l AS (SELECT path, tokens FROM paths ORDER BY tokens DESC, user_id, session_start LIMIT 1)
SELECT (SELECT count(*) FROM paths) AS total_sessions, (SELECT count(DISTINCT user_id) FROM paths) AS total_users,
 (SELECT count(*) FROM ptable) AS distinct_paths, tokens AS longest_tokens, path AS longest_path, users AS longest_users FROM l JOIN ptable USING (path)""")

# ---- item lifecycle --------------------------------------------------------------------------
ITEM_LIFE_SQL = f"""
, ia AS (SELECT max(event_date) AS as_of FROM behaviors),
iw AS (SELECT item_id, CAST(floor((date_diff('day', as_of, event_date) - 1 + 28) / 7.0) AS INT) AS w, count(*) FILTER (behavior_type = 'pv') AS pv,
              count(*) FILTER (behavior_type = 'buy') AS buy
       FROM behaviors, ia WHERE date_diff('day', as_of, event_date) - 1 + 28 >= 0 GROUP BY 1, 2),
ix AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY w) - 1 AS x FROM iw),
it AS (SELECT item_id, list(buy ORDER BY w) AS buy_trend, sum(pv) AS total_pv, CASE WHEN count(*) < 2 OR sum(buy) = 0 THEN 0.0 ELSE round(regr_slope(buy, x), 9) END AS slope
       FROM ix GROUP BY 1),
ig AS (SELECT item_id, round(sum(amount), 2) AS gmv FROM w_lines WHERE order_id IN (SELECT order_id FROM w_orders WHERE status = 'paid') GROUP BY 1),
ij AS (SELECT i.item_id, item_name, round(price, 2) AS price, created_at, as_of, coalesce(buy_trend, [0, 0, 0, 0]) AS buy_trend,
         coalesce(slope, 0.0) AS slope, CAST(coalesce(total_pv, 0) AS BIGINT) AS total_pv, coalesce(gmv, 0.0) AS total_gmv
       FROM w_items i LEFT JOIN it USING (item_id) LEFT JOIN ig USING (item_id), ia),
ik AS (SELECT *, CAST(list_sum(buy_trend) AS BIGINT) AS total_buy, buy_trend[-1] AS recent,
         CASE WHEN len(buy_trend) > 1 THEN buy_trend[-2] ELSE 0 END AS prev FROM ij),
ilife AS (SELECT item_id, item_name, price, CASE WHEN total_buy = 0 THEN '无购买'
   WHEN {elapsed('CAST(as_of AS TIMESTAMP)', 'created_at')} <= 30 THEN '新品' WHEN prev > 0 AND recent <= prev * CAST(0.6 AS DOUBLE) THEN '衰退'
   WHEN recent > 0 AND slope > 0 THEN '成长' WHEN recent >= 10 THEN '爆款' ELSE '成熟' END AS stage,
   buy_trend, {rnd('slope', 4)} AS slope, total_pv, total_buy, total_gmv FROM ik)
"""


def _life(w, **kw):
    return K.item_lifecycle(w.items, w.behaviors, w.order_items, w.orders, ItemLifeSettings(**kw))


def _flat_trend(df):
    return df.withColumn("buy_trend", F.array_join(F.transform("buy_trend", lambda x: x.cast("string")), ","))


_LIFE_OUT = "SELECT * REPLACE (array_to_string(buy_trend, ',') AS buy_trend) FROM ilife"
_LIFE_DIST = ITEM_LIFE_SQL + f"""SELECT s.stage, count(item_id) AS count, {sd('count(item_id)', '(SELECT count(*) FROM ilife)')} AS ratio,
 round(coalesce(sum(total_gmv), 0.0), 2) AS total_gmv
FROM (SELECT unnest(['新品','成长','爆款','成熟','衰退','无购买']) AS stage) s LEFT JOIN ilife USING (stage) GROUP BY 1"""
for _world, _tag in (("event", ""), ("order", "_orders")):
    register(f"E05_item_lifecycle{_tag}", lambda w: _flat_trend(_life(w)), ITEM_LIFE_SQL + _LIFE_OUT, _world)
    register(f"E07_item_stages{_tag}", lambda w: K.item_stage_distribution(_life(w)), _LIFE_DIST, _world)
register("E06_item_stage_zero_filled", lambda w: _life(w, zero_fill=True).select("item_id", "stage", "slope", "total_buy"),
         ITEM_LIFE_SQL.replace("iw AS (SELECT item_id,", "iw0 AS (SELECT item_id,").replace(
             "ix AS (", "iw AS (SELECT s.item_id, s.w, coalesce(pv, 0) AS pv, coalesce(buy, 0) AS buy FROM "
             "(SELECT DISTINCT item_id, unnest(range(4)) AS w FROM iw0) s LEFT JOIN iw0 USING (item_id, w)),\nix AS (", 1)
         + "SELECT item_id, stage, slope, total_buy FROM ilife")

# ---- prices ----------------------------------------------------------------------------------
PRICE_SQL = bins_sql(5) + f"""
, pd AS (SELECT bin, count(*) AS item_count, any_value(e[bin + 1]) AS lo, any_value(e[bin + 2]) AS hi FROM binned GROUP BY 1),
pc AS (SELECT bin, {counts()} FROM behaviors JOIN binned USING (item_id) GROUP BY 1),
ps AS (SELECT bin, count(DISTINCT l.order_id) AS orders, round(sum(amount), 2) AS gmv, count(DISTINCT o.user_id) AS buy_users
       FROM w_lines l JOIN w_orders o ON o.order_id = l.order_id AND o.status = 'paid' JOIN binned USING (item_id) GROUP BY 1),
pj AS (SELECT bin, round(lo, 2) AS price_min, round(hi, 2) AS price_max, item_count, {zeroed(['pv', 'click', 'cart', 'buy', 'orders', 'buy_users'])},
         coalesce(gmv, 0.0) AS gmv FROM pd LEFT JOIN pc USING (bin) LEFT JOIN ps USING (bin)),
pbins AS (SELECT *, {sd('click', 'pv')} AS click_rate, {sd('cart', 'pv')} AS cart_rate, {sd('buy', 'pv')} AS buy_rate,
         {sd('orders', 'buy_users')} AS buy_freq, {rnd(sd('gmv', 'buy_users'), 2)} AS user_value FROM pj)
"""


def _bins(w):
    return K.price_bins(w.items, w.behaviors, w.order_items, w.orders)


def _corr_sql(c):
    return f"coalesce({rnd(f'CASE WHEN isnan(corr(price_min, {c})) THEN 0.0 ELSE corr(price_min, {c}) END', 4)}, 0.0) AS price_vs_{c}"


for _world, _tag in (("event", ""), ("order", "_orders")):
    register(f"E08_price_bins{_tag}", lambda w: K.top_price_bins(_bins(w)), PRICE_SQL + """
SELECT *, printf('(%.2f, %.2f]', price_min, price_max) AS bin_label FROM pbins ORDER BY gmv DESC, bin LIMIT 5""", _world)
    register(f"E09_price_correlation{_tag}", lambda w: K.price_correlations(_bins(w)), PRICE_SQL +
             f"SELECT count(*) AS bins, {', '.join(_corr_sql(c) for c in ('buy_rate', 'buy_freq', 'user_value'))} FROM pbins", _world)

# ---- channels and devices --------------------------------------------------------------------


def _quality_sql(column: str) -> str:
    return f"""
, cd AS (SELECT {column} AS v, count(DISTINCT user_id) AS users, count(*) AS events, {counts()} FROM behaviors GROUP BY 1),
cb AS (SELECT DISTINCT {column} AS v, user_id FROM behaviors WHERE behavior_type = 'buy'),
cg AS (SELECT v, count(order_id) AS orders, round(coalesce(sum(total_amount), 0.0), 2) AS gmv
       FROM cb JOIN w_orders o ON o.user_id = cb.user_id AND status = 'paid' GROUP BY 1)
"""


_CHANNEL = _quality_sql("channel") + f"""
, nu AS (SELECT user_id FROM w_users WHERE date_diff('day', CAST(register_time AS DATE), (SELECT max(event_date) FROM behaviors)) <= 30),
cn AS (SELECT channel AS v, count(DISTINCT user_id) AS new_users FROM behaviors WHERE user_id IN (SELECT user_id FROM nu) GROUP BY 1),
cj AS (SELECT s.v AS channel, {zeroed(['users', 'new_users', *TYPES, 'orders'])}, coalesce(gmv, 0.0) AS gmv
       FROM (SELECT unnest(['organic','search','ads','campaign','recommendation']) AS v) s LEFT JOIN cd USING (v) LEFT JOIN cn USING (v) LEFT JOIN cg USING (v))
SELECT channel, users, new_users, {sd('new_users', 'users')} AS new_user_ratio,
 {sd('users', '(SELECT count(DISTINCT user_id) FROM behaviors)')} AS active_ratio, {_T}, {sd('click', 'pv')} AS click_rate,
 {sd('buy', 'pv')} AS buy_rate, orders, gmv, {sd('gmv', 'orders')} AS aov FROM cj"""
_DEVICE = _quality_sql("device_type") + f"""
, hh AS (SELECT device_type AS v, event_hour, count(*) AS n FROM behaviors GROUP BY 1, 2),
hd AS (SELECT v, sum(n) AS timed, sum(n) FILTER (event_hour BETWEEN 18 AND 23) AS evening FROM hh GROUP BY 1),
hr AS (SELECT v, event_hour AS peak_hour FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY n DESC, event_hour) AS k FROM hh) WHERE k = 1),
cj AS (SELECT s.v AS device, {zeroed(['users', 'events', *TYPES, 'orders'])}, coalesce(gmv, 0.0) AS gmv, timed, evening, peak_hour
       FROM (SELECT unnest(['mobile','pc','tablet']) AS v) s LEFT JOIN cd USING (v) LEFT JOIN cg USING (v) LEFT JOIN hd USING (v) LEFT JOIN hr USING (v))
SELECT device, users, {sd('events', '(SELECT count(*) FROM behaviors)')} AS behavior_ratio, {_T}, {sd('click', 'pv')} AS click_rate,
 {sd('buy', 'pv')} AS buy_rate, orders, gmv, {sd('gmv', 'orders')} AS aov, {sd('evening', 'timed')} AS evening_ratio, peak_hour FROM cj"""
for _world, _tag in (("event", ""), ("order", "_orders")):
    register(f"E10_channel{_tag}", lambda w: K.channel_analysis(w.users, w.behaviors, w.orders), _CHANNEL, _world)
    register(f"E11_device{_tag}", lambda w: K.device_analysis(w.behaviors, w.orders), _DEVICE, _world)

# ---- baskets ---------------------------------------------------------------------------------


def _rules_sql(member: str, table: str, support: float) -> str:
    return f"""
, paid_once AS (SELECT DISTINCT order_id, item_id FROM w_lines WHERE order_id IN (SELECT order_id FROM w_orders WHERE status = 'paid')),
cat_once AS (SELECT DISTINCT order_id, category_id FROM paid_once JOIN w_items USING (item_id)),
n AS (SELECT count(DISTINCT order_id) AS n, (SELECT count(DISTINCT order_id) FROM paid_once) AS total FROM {table}),
one AS (SELECT {member} AS m, count(*) AS c FROM {table} GROUP BY 1),
two AS (SELECT x.{member} AS a, y.{member} AS b, count(*) AS c FROM {table} x JOIN {table} y ON x.order_id = y.order_id AND x.{member} <> y.{member} GROUP BY 1, 2),
rules AS (SELECT a, b, two.c / n AS support, two.c / oa.c AS confidence, round((two.c / oa.c) / (ob.c / n), 9) AS lift, total
  FROM two JOIN one oa ON oa.m = a JOIN one ob ON ob.m = b, n WHERE two.c / n >= {support}),
best AS (SELECT a, b, {rnd('support', 4)} AS support, {rnd('confidence', 4)} AS confidence, {rnd('lift', 4)} AS lift, CAST(round(support * total) AS BIGINT) AS count
  FROM rules WHERE lift >= 1.0 AND confidence >= 0.03 ORDER BY rules.lift DESC, a, b LIMIT 20)
"""


_ITEM_OUT = """SELECT a AS antecedent_id, b AS consequent_id, x.item_name AS antecedent, y.item_name AS consequent, support, confidence, lift, count
FROM best JOIN w_items x ON x.item_id = a JOIN w_items y ON y.item_id = b"""
register("E12_item_rules", lambda w: B.item_rules(w.order_items, w.orders, w.items, BasketSettings(min_support=0.0002)),
         _rules_sql("item_id", "paid_once", 0.0002) + _ITEM_OUT, "order")
register("E13_category_rules", lambda w: B.category_rules(w.order_items, w.orders, w.items),
         _rules_sql("category_id", "cat_once", 0.001) + "SELECT '分类' || a AS antecedent, '分类' || b AS consequent, support, confidence, lift, count FROM best", "order")

# ---- profiles --------------------------------------------------------------------------------


def _flat_user(w):
    df = R.user_profile(w.users, w.behaviors, w.orders, w.order_items, w.items)

    def text(c):
        return F.array_join(F.transform(c, lambda x: F.concat(x["value"], F.lit(":"), x["count"].cast("string"))), ",")
    return df.select("user_id", "basic.*", "behavior.*", "purchase.*", "spending_power", "active_time.*",
                     text("preferred_categories").alias("categories"), text("preferred_brands").alias("brands"),
                     "lifecycle_stage", F.col("rfm.rfm_score").alias("rfm_score"), F.col("rfm.segment").alias("segment"), "channel", "device")


def _mode_cte(name, expr):
    return f"""{name} AS (SELECT user_id, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, v) AS k
  FROM (SELECT user_id, {expr} AS v, count(*) AS n FROM behaviors GROUP BY 1, 2)) WHERE k = 1)"""


def _top_cte(name, col):
    return f"""{name} AS (SELECT user_id, string_agg({col} || ':' || n, ',' ORDER BY k) AS t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, {col}) AS k
  FROM (SELECT user_id, {col}, count(*) AS n FROM behaviors JOIN w_items USING (item_id) GROUP BY 1, 2)) WHERE k <= 3 GROUP BY 1)"""


_PROFILE = RFM_SQL + LIFE_SQL + f""", pc AS (SELECT user_id, {counts()}, count(DISTINCT event_date) AS active_days FROM behaviors GROUP BY 1),
pg AS (SELECT user_id, count(*) AS order_count, round(sum(total_amount), 2) AS gmv FROM w_orders WHERE status = 'paid' GROUP BY 1),
{_mode_cte('mh', 'event_hour')}, {_mode_cte('mw', 'isodow(event_date) - 1')}, {_mode_cte('mc', 'channel')}, {_mode_cte('md', 'device_type')},
{_top_cte('tc', 'category_id')}, {_top_cte('tb', 'brand')},
pj AS (SELECT u.*, {zeroed([*TYPES, 'active_days', 'order_count'])}, coalesce(gmv, 0.0) AS gmv, mh.v AS peak_hour, mw.v AS peak_weekday, mc.v AS channel, md.v AS device,
  coalesce(tc.t, '') AS categories, coalesce(tb.t, '') AS brands
  FROM w_users u LEFT JOIN pc USING (user_id) LEFT JOIN pg USING (user_id) LEFT JOIN mh USING (user_id) LEFT JOIN mw USING (user_id)
  LEFT JOIN mc USING (user_id) LEFT JOIN md USING (user_id) LEFT JOIN tc USING (user_id) LEFT JOIN tb USING (user_id))
SELECT pj.user_id, age, gender, city, {elapsed('(SELECT CAST(max(event_date) AS TIMESTAMP) FROM behaviors)', 'register_time')} AS register_days, {_T}, active_days,
 order_count, gmv, {sd('gmv', 'order_count')} AS aov, {_TIER} AS spending_power, peak_hour, peak_weekday, categories, brands, life.stage AS lifecycle_stage,
 rfm_score, segment, channel, device FROM pj LEFT JOIN life USING (user_id) LEFT JOIN rfm USING (user_id)"""


def _flat_item(w):
    df = R.item_profile(w.items, w.behaviors, w.order_items, w.orders)
    return df.select("item_id", "item_name", "basic.*", "behavior.*", "sales.*", "lifecycle_stage", "price_band", "heat_score").withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


_ITEM_PROFILE = ITEM_LIFE_SQL + f""", pc AS (SELECT item_id, {counts()}, count(DISTINCT user_id) AS unique_users FROM behaviors GROUP BY 1),
pg AS (SELECT item_id, sum(quantity) AS sold, count(DISTINCT order_id) AS orders, round(sum(amount), 2) AS gmv FROM w_lines
       WHERE order_id IN (SELECT order_id FROM w_orders WHERE status = 'paid') GROUP BY 1),
pq AS (SELECT quantile_cont(CAST(price AS DOUBLE), [0.25, 0.75]) AS q FROM w_items),
pj AS (SELECT i.*, {zeroed([*TYPES, 'unique_users', 'orders'])}, CAST(coalesce(sold, 0) AS DOUBLE) AS sold, coalesce(gmv, 0.0) AS gmv, q
  FROM w_items i LEFT JOIN pc USING (item_id) LEFT JOIN pg USING (item_id), pq)
SELECT pj.item_id, pj.item_name, category_id, brand, round(pj.price, 2) AS price, stock, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, {_T},
 unique_users, {sd('buy', 'pv')} AS conversion_rate, sold, orders, gmv, stage AS lifecycle_stage,
 CASE WHEN pj.price <= 0 THEN '免费/无效' WHEN pj.price <= q[1] THEN '低价带' WHEN pj.price <= q[2] THEN '中价带' ELSE '高价带' END AS price_band,
 CAST(pv + 2*click + 3*collect + 4*cart + 5*buy AS DOUBLE) AS heat_score FROM pj JOIN ilife USING (item_id)"""
for _world, _tag in (("event", ""), ("order", "_orders")):
    register(f"E17_user_profile{_tag}", _flat_user, _PROFILE, _world)
    register(f"E18_item_profile{_tag}", _flat_item, _ITEM_PROFILE, _world)
