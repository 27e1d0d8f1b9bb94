"""Registered queries: recommenders and their offline evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as I
from ..operators import recommend as H
from ..plans.recommend import batch_recommendations
from ..session import cut_lineage
from ..settings import WEIGHT_SETS, EvaluationSettings, RecommendSettings
from .registry import register
from .sqltext import TYPES, rnd

CFG = RecommendSettings()
EVAL = EvaluationSettings()


def weight_case(weights=CFG.weights) -> str:
    return "CASE behavior_type " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in weights.items()) + " ELSE 0.0 END"


def base_sql(source: str = "behaviors", ref: str = "(SELECT max(event_date) FROM behaviors)", orders: str = "w_orders",
             weights=CFG.weights, tag: str = "") -> str:
    """Weights, decayed weights, popular list, shelf and purchases over one source of behaviours."""
    decay = f"power(0.5, greatest(date_diff('day', event_date, {ref}), 0) / 7.0)"
    comps = ", ".join(f"coalesce(sum(CASE WHEN behavior_type = '{t}' THEN d END), 0.0) AS {t}" for t in TYPES)
    parts = " + ".join(f"{weights[t]} * coalesce({t} / nullif(max({t}) OVER (), 0), 0.0)" for t in TYPES)
    return f"""
, wt{tag} AS (SELECT user_id, item_id, CAST(sum({weight_case(weights)}) AS DOUBLE) AS w FROM {source} GROUP BY 1, 2 HAVING sum({weight_case(weights)}) > 0),
dw{tag} AS (SELECT user_id, item_id, CAST(sum({weight_case(weights)} * {decay}) AS DOUBLE) AS w FROM {source} GROUP BY 1, 2 HAVING sum({weight_case(weights)}) > 0),
pc{tag} AS (SELECT item_id, {comps} FROM (SELECT item_id, behavior_type, {decay} AS d FROM {source} WHERE behavior_type IN {TYPES}) GROUP BY 1),
ps{tag} AS (SELECT item_id, CAST({parts} AS DOUBLE) AS s FROM pc{tag}),
pop{tag} AS (SELECT item_id, CASE WHEN max(s) OVER () > min(s) OVER () THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE 0.0 END AS score FROM ps{tag}),
shelf{tag} AS (SELECT item_id FROM w_items WHERE status = 1),
bought{tag} AS (SELECT DISTINCT user_id, item_id FROM w_lines JOIN {orders} USING (order_id) WHERE status = 'paid')"""


def global_topk_sql(scores: str, users: str, k: int = 10, tag: str = "") -> str:
    return f"""SELECT user_id, item_id, rank, {rnd('score', 4)} AS score FROM (
 SELECT u.user_id, s.item_id, score, row_number() OVER (PARTITION BY u.user_id ORDER BY round(score, 6) DESC, s.item_id) AS rank
 FROM {users} u, {scores} s JOIN shelf{tag} USING (item_id) WHERE NOT EXISTS (SELECT 1 FROM bought{tag} b WHERE b.user_id = u.user_id AND b.item_id = s.item_id)
) WHERE rank <= {k}"""


def personal_topk_sql(scores: str, k: int = 10, tag: str = "") -> str:
    return f"""SELECT user_id, item_id, rank, {rnd('score', 4)} AS score FROM (
 SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item_id) AS rank
 FROM {scores} JOIN shelf{tag} USING (item_id) WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM bought{tag})) WHERE rank <= {k}"""


def cf_sql(tag: str = "") -> str:
    return f"""
, ni{tag} AS (SELECT item_id, sum(w * w) AS sq FROM wt{tag} GROUP BY 1),
simi{tag} AS (SELECT x.item_id AS a, y.item_id AS b, sum(x.w * y.w) AS dot FROM wt{tag} x JOIN wt{tag} y USING (user_id) GROUP BY 1, 2),
sim{tag} AS (SELECT a, b, dot / (sqrt(na.sq) * sqrt(nb.sq + 1e-9)) AS sim FROM simi{tag} JOIN ni{tag} na ON na.item_id = a JOIN ni{tag} nb ON nb.item_id = b),
icf{tag} AS (SELECT user_id, b AS item_id, sum(w * sim) AS score FROM wt{tag} JOIN sim{tag} ON a = item_id GROUP BY 1, 2),
nu{tag} AS (SELECT user_id, sqrt(sum(w * w)) AS n FROM wt{tag} GROUP BY 1),
ud{tag} AS (SELECT x.user_id AS a, y.user_id AS b, sum(x.w * y.w) AS dot FROM wt{tag} x JOIN wt{tag} y ON x.item_id = y.item_id AND x.user_id <> y.user_id GROUP BY 1, 2),
us{tag} AS (SELECT a, b, dot / (na.n * nb.n + 1e-9) AS sim FROM ud{tag} JOIN nu{tag} na ON na.user_id = a JOIN nu{tag} nb ON nb.user_id = b),
near{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS rank FROM us{tag}) WHERE rank <= 50),
ucf{tag} AS (SELECT a AS user_id, item_id, sum(sim * w) AS score FROM near{tag} JOIN wt{tag} ON user_id = b GROUP BY 1, 2),
tot{tag} AS (SELECT item_id, sum(w) AS s FROM wt{tag} GROUP BY 1),
fallback{tag} AS (SELECT item_id, CASE WHEN max(s) OVER () > min(s) OVER () THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE 0.0 END AS score FROM tot{tag})"""


def content_sql(tag: str = "") -> str:
    return f"""
, q AS (SELECT list_sort(list_distinct(quantile_cont(CAST(price AS DOUBLE), [0.0, 0.25, 0.5, 0.75, 1.0]))) AS e FROM w_items),
onehot AS (SELECT item_id, unnest(['category=' || category_id, 'brand=' || brand,
   'price=' || least(len(list_filter(e[2:], lambda x: x < CAST(price AS DOUBLE))), len(e) - 2)]) AS feature, 1.0::DOUBLE AS value FROM w_items, q),
tok AS (SELECT item_id, lower(t) AS token, count(*) AS tf FROM (SELECT item_id, brand, unnest(regexp_extract_all(item_name, '[一-鿿A-Za-z0-9]+')) AS t FROM w_items)
        WHERE t <> brand GROUP BY 1, 2),
idf AS (SELECT token, ln(((SELECT count(*) FROM w_items) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM tok GROUP BY 1),
tv AS (SELECT item_id, token, tf * idf AS v FROM tok JOIN idf USING (token)),
tn AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM tv GROUP BY 1),
feats AS (SELECT item_id, feature, value FROM onehot UNION ALL SELECT item_id, 'token=' || token, v / n FROM tv JOIN tn USING (item_id)),
fnorm AS (SELECT item_id, sqrt(sum(value * value)) AS n FROM feats GROUP BY 1),
seeds{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(w, 9) DESC, item_id) AS k FROM dw{tag}) WHERE k <= 20),
taste{tag} AS (SELECT user_id, feature, sum(w * value / n) AS t FROM seeds{tag} JOIN feats USING (item_id) JOIN fnorm USING (item_id) GROUP BY 1, 2),
con{tag} AS (SELECT user_id, item_id, sum(t * value / (n + 1e-9)) AS score FROM taste{tag} JOIN feats USING (feature) JOIN fnorm USING (item_id)
   JOIN shelf{tag} USING (item_id) GROUP BY 1, 2),
rtot{tag} AS (SELECT item_id, sum(w) AS s FROM dw{tag} GROUP BY 1),
rfall{tag} AS (SELECT item_id, CASE WHEN max(s) OVER () > min(s) OVER () THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE 0.0 END AS score FROM rtot{tag})"""


def _mm(c: str, over: str) -> str:
    return f"coalesce(({c} - min({c}) OVER {over}) / nullif(max({c}) OVER {over} - min({c}) OVER {over}, 0), 0.0)"


HYBRID_SQL = f"""
, dense AS (SELECT u.user_id, s.item_id, coalesce(icf.score, 0.0) AS a, coalesce(ucf.score, 0.0) AS b, coalesce(pop.score, 0.0) AS c, coalesce(con.score, 0.0) AS d
  FROM (SELECT DISTINCT user_id FROM wt) u CROSS JOIN shelf s LEFT JOIN icf ON icf.user_id = u.user_id AND icf.item_id = s.item_id
  LEFT JOIN ucf ON ucf.user_id = u.user_id AND ucf.item_id = s.item_id LEFT JOIN pop ON pop.item_id = s.item_id
  LEFT JOIN con ON con.user_id = u.user_id AND con.item_id = s.item_id
  WHERE NOT EXISTS (SELECT 1 FROM bought b WHERE b.user_id = u.user_id AND b.item_id = s.item_id)),
hyb AS (SELECT user_id, item_id, 0.25 * {_mm('a', 'p')} + 0.15 * {_mm('b', 'p')} + 0.30 * {_mm('c', 'p')} + 0.30 * {_mm('d', 'p')} AS score FROM dense WINDOW p AS (PARTITION BY user_id)),
gl AS (SELECT s.item_id, coalesce(f.score, 0.0) AS a, coalesce(pop.score, 0.0) AS c, coalesce(r.score, 0.0) AS d
  FROM shelf s LEFT JOIN fallback f USING (item_id) LEFT JOIN pop USING (item_id) LEFT JOIN rfall r USING (item_id)),
glb AS (SELECT item_id, 0.40 * {_mm('a', '()')} + 0.30 * {_mm('c', '()')} + 0.30 * {_mm('d', '()')} AS score FROM gl),
glp AS (SELECT * FROM glb WHERE score > 0)
"""


def _args(w):
    return w.behaviors, w.items, w.orders, w.order_items, w.users


def _w(w):
    return H.user_item_weights(w.behaviors, CFG)


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


_KNOWN = "(SELECT DISTINCT user_id FROM wt)"
_COLD = "(SELECT user_id FROM w_users WHERE user_id NOT IN (SELECT user_id FROM wt))"

register("H01_candidate_filter", lambda w: H.candidates(_w(w).select("user_id", "item_id"), H.on_shelf(w.items, CFG), H.purchased(w.orders, w.order_items)),
         base_sql() + " SELECT user_id, item_id FROM wt JOIN shelf USING (item_id) WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM bought)")
register("H02_top_k", lambda w: H.with_attributes(H.top_k(_w(w).withColumnRenamed("w", "score"), 10), w.items, "itemcf").drop("reason"),
         base_sql() + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, item_id) AS rank FROM wt)
 SELECT user_id, item_id, rank, round(w, 4) AS score, item_name, category_id, brand, round(price, 2) AS price FROM r JOIN w_items USING (item_id) WHERE rank <= 10""")
register("H03_weighted_item_score", lambda w: _r6(H.decayed_user_items(w.behaviors, CFG, H.reference_day(w.behaviors, CFG)).groupBy("item_id").agg(F.sum("w").alias("score")), "score"),
         base_sql() + " SELECT item_id, round(sum(w), 6) AS score FROM dw GROUP BY 1")
register("H04_popular_scores", lambda w: _r6(H.popular_scores(w.behaviors, CFG), "score"), base_sql() + " SELECT item_id, round(score, 6) AS score FROM pop")
register("H04_popular_top_k", lambda w: H.recommend_popular(*_args(w)), base_sql() + " " + global_topk_sql("pop", "w_users"))
register("H05_user_item_weights", lambda w: _w(w), base_sql() + " SELECT * FROM wt")
register("H06_item_similarity", lambda w: _r6(H.item_similarity(_w(w)), "sim"), base_sql() + cf_sql() + " SELECT a, b, round(sim, 6) AS sim FROM sim")
register("H07_itemcf_scores", lambda w: _r6(H.itemcf_scores(_w(w)), "score"), base_sql() + cf_sql() + " SELECT user_id, item_id, round(score, 6) AS score FROM icf")
register("H08_itemcf_top_k", lambda w: H.recommend_itemcf(*_args(w)),
         base_sql() + cf_sql() + " " + personal_topk_sql("icf") + " UNION ALL " + global_topk_sql("fallback", _COLD))
register("H09_user_neighbors", lambda w: _r6(H.user_neighbors(_w(w)), "sim"),
         base_sql() + cf_sql() + " SELECT a AS user_id, b AS neighbor_id, round(sim, 6) AS sim, rank FROM near")
register("H10_usercf_top_k", lambda w: H.recommend_usercf(*_args(w)),
         base_sql() + cf_sql() + " " + personal_topk_sql("ucf") + " UNION ALL " + global_topk_sql("fallback", _COLD))
register("H11_content_features", lambda w: _r6(H.content_features(w.items), "value"),
         base_sql() + content_sql() + " SELECT item_id, feature, round(value, 6) AS value FROM feats")
register("H12_user_seeds", lambda w: _r6(H.user_seeds(w.behaviors, CFG), "w"), base_sql() + content_sql() + " SELECT user_id, item_id, round(w, 6) AS w FROM seeds")
register("H13_content_scores", lambda w: _r6(H.content_scores(H.user_seeds(w.behaviors, CFG), H.content_features(w.items), H.on_shelf(w.items, CFG)), "score"),
         base_sql() + content_sql() + " SELECT user_id, item_id, round(score, 6) AS score FROM con")
register("H14_content_top_k", lambda w: H.recommend_content(*_args(w)),
         base_sql() + content_sql() + " " + personal_topk_sql("con") + " UNION ALL " + global_topk_sql("rfall", _COLD))
register("H15_hybrid_scores_top", lambda w: H.top_k(H.hybrid_scores(*_args(w), top=10), 10),
         base_sql() + cf_sql() + content_sql() + HYBRID_SQL + " " + personal_topk_sql("hyb"))
register("H15_hybrid_top_k", lambda w: H.recommend_hybrid(*_args(w)),
         base_sql() + cf_sql() + content_sql() + HYBRID_SQL + " " + personal_topk_sql("hyb") + " UNION ALL " + global_topk_sql("glp", _COLD))


def _active(w):
    return w.behaviors.select("user_id").distinct()


register("H16_batch_lists", lambda w: batch_recommendations(w.behaviors, w.items, w.orders, w.order_items, _active(w), CFG).select("algorithm", "user_id", "item_id", "rank", "score"),
         base_sql() + cf_sql() + content_sql() + HYBRID_SQL + " UNION ALL ".join(f"SELECT '{n}' AS algorithm, * FROM ({q})" for n, q in {
             "popular": global_topk_sql("pop", _KNOWN), "itemcf": personal_topk_sql("icf"), "usercf": personal_topk_sql("ucf"),
             "content": personal_topk_sql("con"), "hybrid": personal_topk_sql("hyb")}.items()))

# ---- evaluation ------------------------------------------------------------------------------
EVAL_SQL = """
, ev AS (SELECT min(event_date) AS lo, max(event_date) AS hi FROM behaviors),
cut AS (SELECT CASE WHEN hi - CAST(greatest(1, round_even(date_diff('day', lo, hi) * 0.25, 0)) AS INT) <= lo THEN lo + 1
   ELSE hi - CAST(greatest(1, round_even(date_diff('day', lo, hi) * 0.25, 0)) AS INT) END AS c FROM ev),
train AS (SELECT * FROM behaviors WHERE event_date <= (SELECT c FROM cut)),
test AS (SELECT * FROM behaviors WHERE event_date > (SELECT c FROM cut)),
truth AS (SELECT DISTINCT user_id, item_id FROM test),
rel AS (SELECT user_id, count(*) AS n FROM truth GROUP BY 1),
past AS (SELECT * FROM w_orders WHERE CAST(order_time AS DATE) <= (SELECT c FROM cut))"""


def eval_base(orders: str = "past", weights=CFG.weights, tag: str = "") -> str:
    return base_sql("train", "(SELECT c FROM cut)", orders, weights, tag)


def per_user_sql(recs: str) -> str:
    return f"""(SELECT r.user_id, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN h > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END, 6) AS f1,
   CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate, round(dcg / idcg, 6) AS ndcg
 FROM (SELECT rel.user_id, count(t.item_id) AS h, count(t.item_id) / 10.0::DOUBLE AS p, count(t.item_id) / any_value(rel.n)::DOUBLE AS rc,
     coalesce(sum(CASE WHEN t.item_id IS NOT NULL THEN 1.0 / log2(x.rank + 1.0) END), 0.0) AS dcg,
     any_value(list_sum(list_transform(range(1, least(rel.n, 10) + 1), lambda i: 1.0 / log2(i + 1.0)))) AS idcg
   FROM rel LEFT JOIN ({recs}) x USING (user_id) LEFT JOIN truth t ON t.user_id = x.user_id AND t.item_id = x.item_id GROUP BY 1) r)"""


def summary_sql(recs: str) -> str:
    mean = ", ".join(f"{rnd(f'avg({m})', 4)} AS {m}" for m in I.METRICS)
    return f"""SELECT {mean}, count(*) AS n_users,
 {rnd(f"(SELECT count(DISTINCT item_id) FROM ({recs})) / (SELECT count(*) FROM w_items)::DOUBLE", 4)} AS coverage FROM {per_user_sql(recs)}"""


_POP_EVAL = global_topk_sql("pop", "rel")


def _cut(w):
    cut = I.cut_day(w.behaviors)
    counts = w.behaviors.groupBy(F.coalesce(F.col("event_date") > cut, F.lit(False)).alias("test")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("cut", cut.cast("string"))


register("I01_time_split", _cut, EVAL_SQL + """ SELECT CAST(event_date > c AS BIGINT) AS test, count(*) AS rows, CAST(c AS VARCHAR) AS cut FROM behaviors, cut GROUP BY 1, c""")
register("I02_ground_truth", lambda w: I.ground_truth(I.split_in_time(w.behaviors, I.cut_day(w.behaviors))[1]), EVAL_SQL + " SELECT * FROM truth")


def _eval_recs(w, algorithm="popular", leak=False):
    cut, train, truth, users = I._test_setup(w.behaviors, EVAL)
    orders = w.orders if leak else w.orders.filter(F.to_date("order_time") <= cut)
    return H.RECOMMENDERS[algorithm](train, w.items, orders, w.order_items, users, CFG, cut), truth


register("I03_user_metrics", lambda w: I.ranking_metrics(*_eval_recs(w)), EVAL_SQL + eval_base() + f" SELECT * FROM {per_user_sql(_POP_EVAL)}")
register("I04_coverage", lambda w: w.items.agg(F.count(F.lit(1)).alias("items")).withColumn("coverage", I.coverage(_eval_recs(w)[0], w.items)),
         EVAL_SQL + eval_base() + f" SELECT count(*) AS items, {rnd(f'(SELECT count(DISTINCT item_id) FROM ({_POP_EVAL})) / count(*)::DOUBLE', 4)} AS coverage FROM w_items")
register("I05_evaluate_popular", lambda w: I.evaluate_recommender("popular", w.behaviors, w.items, w.orders, w.order_items, EVAL), EVAL_SQL + eval_base() + " " + summary_sql(_POP_EVAL))
register("I05_evaluate_popular_all_purchases", lambda w: I.evaluate_recommender("popular", w.behaviors, w.items, w.orders, w.order_items, EVAL, leak_purchases=True),
         EVAL_SQL + eval_base("w_orders") + " " + summary_sql(_POP_EVAL))
_WEIGHT_PARTS = EVAL_SQL + "".join(eval_base(weights=ws, tag=f"_{n[0].lower()}") for n, ws in WEIGHT_SETS.items()) + ", exps AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS experiment, {', '.join(f'{ws[t]}::DOUBLE AS {t}' for t in TYPES)}, * FROM (" + summary_sql(global_topk_sql(f"pop_{n[0].lower()}", "rel", tag=f"_{n[0].lower()}")) + ")"
    for n, ws in WEIGHT_SETS.items()) + ")"


def _experiment(w):
    return I.weight_experiment(w.behaviors, w.items, w.orders, w.order_items, EVAL)


register("I06_weight_experiment", _experiment, _WEIGHT_PARTS + " SELECT *, row_number() OVER (ORDER BY ndcg DESC, recall DESC, experiment) AS rank FROM exps")
register("I07_choose_best", lambda w: I.choose_best(_experiment(w)), _WEIGHT_PARTS + " SELECT experiment AS best, ndcg, recall FROM exps ORDER BY ndcg DESC, recall DESC, experiment LIMIT 1")

_COLD_T = "(SELECT user_id FROM rel WHERE user_id NOT IN (SELECT user_id FROM wt))"


def _only(q: str) -> str:
    return f"SELECT z.* FROM ({q}) z JOIN rel USING (user_id)"


_COMPARE = EVAL_SQL + eval_base() + cf_sql() + content_sql() + HYBRID_SQL + ", cmp AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS algorithm, * FROM ({summary_sql(q)})" for n, q in {
        "popular": _POP_EVAL,
        "itemcf": _only(personal_topk_sql("icf")) + " UNION ALL " + global_topk_sql("fallback", _COLD_T),
        "usercf": _only(personal_topk_sql("ucf")) + " UNION ALL " + global_topk_sql("fallback", _COLD_T),
        "content": _only(personal_topk_sql("con")) + " UNION ALL " + global_topk_sql("rfall", _COLD_T),
        "hybrid": _only(personal_topk_sql("hyb")) + " UNION ALL " + global_topk_sql("glp", _COLD_T),
    }.items()) + ")"


def _compare(w):
    """The five result rows are written once, since ranking and reports read them several times."""
    return cut_lineage(I.compare_algorithms(w.behaviors, w.items, w.orders, w.order_items, EVAL))


register("I08_compare_algorithms", _compare, _COMPARE + " SELECT *, row_number() OVER (ORDER BY ndcg DESC, recall DESC, algorithm) AS rank FROM cmp")
register("I09_report_table", lambda w: I.report_table(_compare(w)), _COMPARE + """
 SELECT algorithm AS "Algorithm", precision AS "Precision@10", recall AS "Recall@10", f1 AS "F1@10", hit_rate AS "HitRate@10", ndcg AS "NDCG@10", coverage AS "Coverage" FROM cmp""")
register("I10_conclusion", lambda w: I.conclusion(_compare(w)), _COMPARE + """
, b AS (SELECT ndcg AS n FROM cmp WHERE algorithm = 'popular')
 SELECT algorithm AS candidate, ndcg AS candidate_ndcg, 'popular' AS baseline, n AS baseline_ndcg, CAST(ndcg > n AS BIGINT) AS is_better
 FROM cmp, b WHERE algorithm <> 'popular' ORDER BY ndcg DESC, algorithm DESC LIMIT 1""")
