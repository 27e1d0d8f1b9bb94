"""Offline ranking evaluation on a split in time."""

from __future__ import annotations

import math
from dataclasses import replace
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import scalar_row
from ..session import cut_lineage
from ..settings import WEIGHT_SETS, EvaluationSettings, RecommendSettings
from .recommend import RECOMMENDERS, global_heads, on_shelf, popular_scores_by_weights, purchased

METRICS = ("precision", "recall", "f1", "hit_rate", "ndcg")


def cut_day(behaviors: DataFrame, test_ratio: float = 0.25, ref_day: str | None = None) -> Column:
    """Last training day: the final share of the covered days is the test part.

    Resolved once to a literal, so the date filters reach the scan.
    """
    low, high = behaviors.agg(F.min("event_date"), F.max("event_date")).first()
    last = date.fromisoformat(ref_day) if ref_day else high
    cut = last - timedelta(days=max(1, round((last - low).days * test_ratio)))
    return F.lit(cut if cut > low else low + timedelta(days=1)).cast("date")


def split_in_time(behaviors: DataFrame, cut: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a date stay in the training part."""
    later = F.coalesce(F.col("event_date") > cut, F.lit(False))
    return behaviors.filter(~later), behaviors.filter(later)


def ground_truth(test: DataFrame) -> DataFrame:
    return test.select("user_id", "item_id").distinct()


def ranking_metrics(recs: DataFrame, truth: DataFrame, k: int = 10, by: str | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1, hit rate and NDCG at ``k`` per user with a ground truth.

    With ``by``, ``recs`` holds several lists told apart by that column, and each of ``names`` is measured for every user.
    """
    keys = [by] if by else []
    relevant = truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    gain = F.lit(1.0) / F.log2(F.col("rank") + 1.0)
    hits = (
        recs.filter(F.col("rank") <= k).join(truth, ["user_id", "item_id"], "left_semi")
        .groupBy(*keys, "user_id").agg(F.count(F.lit(1)).alias("hits"), F.sum(gain).alias("dcg"))
    )
    ideal = F.array(*[F.lit(sum(1.0 / math.log2(i + 2) for i in range(n))) for n in range(1, k + 1)])
    if by:
        relevant = relevant.withColumn(by, F.explode(F.array(*[F.lit(n) for n in names])))
    table = relevant.join(hits, [*keys, "user_id"], "left").fillna(0, subset=["hits", "dcg"])
    precision = F.col("hits") / F.lit(float(max(1, k)))
    recall = F.col("hits") / F.col("n_relevant")
    f1 = F.when(F.col("hits") > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    ndcg = F.col("dcg") / F.element_at(ideal, F.least("n_relevant", F.lit(k)).cast("int"))
    return table.select(
        *keys, "user_id", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"),
        F.round(f1, 6).alias("f1"), (F.col("hits") > 0).cast("double").alias("hit_rate"), F.round(ndcg, 6).alias("ndcg"))


def coverage(recs: DataFrame, items: DataFrame, k: int = 10) -> Column:
    """Share of the catalogue that appears in anybody's first ``k``."""
    shown = recs.filter(F.col("rank") <= k).select("item_id").distinct().join(
        items.select("item_id").distinct(), "item_id", "left_semi")
    n = scalar_row(shown, n=F.count(F.lit(1)))["n"]
    total = scalar_row(items.select("item_id"), n=F.count(F.lit(1)))["n"]
    return F.round(F.coalesce(F.try_divide(n, total), F.lit(0.0)), 4)


def evaluate(recs: DataFrame, truth: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Means of the per-user metrics and the coverage, one row."""
    users = truth.select("user_id").distinct()
    recs = recs.join(users, "user_id", "left_semi")
    means = [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 4).alias(m) for m in METRICS]
    return ranking_metrics(recs, truth, k).agg(*means, F.count(F.lit(1)).alias("n_users")).withColumn(
        "coverage", coverage(recs, items, k))


def evaluate_lists(lists: DataFrame, truth: DataFrame, items: DataFrame, k: int, by: str, names: tuple[str, ...]) -> DataFrame:
    """``evaluate`` for several lists at once: one row per name, from one pass over all of them."""
    users = truth.select("user_id").distinct()
    lists = lists.join(users, "user_id", "left_semi")
    means = [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 4).alias(m) for m in METRICS]
    rows = ranking_metrics(lists, truth, k, by, names).groupBy(by).agg(*means, F.count(F.lit(1)).alias("n_users"))
    total = scalar_row(items.select("item_id"), n=F.count(F.lit(1)))["n"]
    shown = lists.filter(F.col("rank") <= k).select(by, "item_id").distinct().join(
        items.select("item_id").distinct(), "item_id", "left_semi").groupBy(by).agg(F.count(F.lit(1)).alias("shown"))
    every = items.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias(by))
    share = F.round(F.coalesce(F.try_divide(F.coalesce("shown", F.lit(0)), total), F.lit(0.0)), 4)
    return every.join(rows, by, "left").join(shown, by, "left").fillna(0, [*METRICS, "n_users"]).select(
        by, *METRICS, "n_users", share.alias("coverage"))


def _test_setup(behaviors: DataFrame, cfg: EvaluationSettings):
    cut = cut_day(behaviors, cfg.test_ratio)
    train, test = split_in_time(behaviors, cut)
    truth = ground_truth(test)
    return cut, train, truth, truth.select("user_id").distinct()


def _known_orders(orders: DataFrame, cut: Column, leak_purchases: bool) -> DataFrame:
    return orders if leak_purchases else orders.filter(F.to_date("order_time") <= cut)


def evaluate_recommender(algorithm: str, behaviors, items, orders, order_items, cfg: EvaluationSettings,
                         settings: RecommendSettings = RecommendSettings(), leak_purchases: bool = False) -> DataFrame:
    """Train up to the cut, compare with what follows, for every user that has a ground truth.

    Purchases made after the cut stay candidates unless ``leak_purchases`` asks for the filter that
    knows them already.
    """
    cut, train, truth, users = _test_setup(behaviors, cfg)
    known = _known_orders(orders, cut, leak_purchases)
    recs = RECOMMENDERS[algorithm](train, items, known, order_items, users, replace(settings, top_k=cfg.k), cut)
    return evaluate(cut_lineage(recs), truth, items, cfg.k)


def _evaluated(variants: dict[str, tuple[str, RecommendSettings]], name: str, behaviors, items, orders, order_items,
               cfg: EvaluationSettings, leak_purchases: bool) -> DataFrame:
    """Lists of all variants over one split, written once and measured in one job."""
    cut, train, truth, users = _test_setup(behaviors, cfg)
    truth, users = cut_lineage(truth), cut_lineage(users)
    known = _known_orders(orders, cut, leak_purchases)
    lists = cut_lineage(reduce(DataFrame.unionByName, [
        RECOMMENDERS[a](train, items, known, order_items, users, replace(s, top_k=cfg.k), cut)
        .select(F.lit(v).alias(name), "user_id", "item_id", F.col("rank").cast("int").alias("rank")) for v, (a, s) in variants.items()]))
    return evaluate_lists(lists, truth, items, cfg.k, name, tuple(variants))


def _ranked(table: DataFrame) -> DataFrame:
    """Rank a handful of result rows by NDCG (as many as there are variants)."""
    name = table.columns[0]
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ndcg"), F.desc("recall"), name)))


def weight_experiment(behaviors, items, orders, order_items, cfg: EvaluationSettings = EvaluationSettings(),
                      settings: RecommendSettings = RecommendSettings(), sets: dict = WEIGHT_SETS,
                      leak_purchases: bool = False) -> DataFrame:
    """The popular list under several sets of weights, ranked; the sets are rows of one job, the behaviours are reduced once."""
    cut, train, truth, users = _test_setup(behaviors, cfg)
    truth, users = cut_lineage(truth), cut_lineage(users)
    names, cfg_k = tuple(sets), replace(settings, top_k=cfg.k)
    scores = popular_scores_by_weights(train, sets, "experiment", cfg_k, cut).join(on_shelf(items, cfg_k), "item_id", "left_semi")
    known = _known_orders(orders, cut, leak_purchases)
    bought = purchased(known, order_items, cfg_k.purchased_until) if cfg_k.drop_purchased else None
    lists = cut_lineage(global_heads(scores, users, bought, cfg.k, "experiment", names))
    rows = evaluate_lists(lists, truth, items, cfg.k, "experiment", names)
    types = next(iter(sets.values()))
    weights = [reduce(lambda c, n: F.when(F.col("experiment") == n, F.lit(sets[n][t])).otherwise(c), sets, F.lit(None).cast("double")).alias(t)
               for t in types]
    return _ranked(rows.select("experiment", *weights, *rows.columns[1:]))


def choose_best(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("ndcg"), F.desc("recall"), summary.columns[0]).limit(1).select(
        F.col(summary.columns[0]).alias("best"), "ndcg", "recall")


def compare_algorithms(behaviors, items, orders, order_items, cfg: EvaluationSettings = EvaluationSettings(),
                       settings: RecommendSettings = RecommendSettings(), algorithms=tuple(RECOMMENDERS),
                       leak_purchases: bool = False) -> DataFrame:
    variants = {a: (a, settings) for a in algorithms}
    return _ranked(_evaluated(variants, "algorithm", behaviors, items, orders, order_items, cfg, leak_purchases))


def report_table(summary: DataFrame, k: int = 10) -> DataFrame:
    titles = {"precision": "Precision", "recall": "Recall", "f1": "F1", "hit_rate": "HitRate", "ndcg": "NDCG"}
    return summary.select(F.col("algorithm").alias("Algorithm"),
                          *[F.col(m).alias(f"{t}@{k}") for m, t in titles.items()], F.col("coverage").alias("Coverage"))


def conclusion(summary: DataFrame, baseline: str = "popular") -> DataFrame:
    """Best other algorithm against the baseline; better only if strictly higher."""
    base = summary.filter(F.col("algorithm") == baseline).agg(F.coalesce(F.max("ndcg"), F.lit(0.0)).alias("x")).scalar()
    best = summary.filter(F.col("algorithm") != baseline).agg(
        F.max_by("algorithm", F.struct("ndcg", "algorithm")).alias("candidate"), F.max("ndcg").alias("candidate_ndcg"))
    return best.withColumn("baseline", F.lit(baseline)).withColumn("baseline_ndcg", base).withColumn(
        "is_better", F.coalesce(F.col("candidate_ndcg") > F.col("baseline_ndcg"), F.lit(False)))
