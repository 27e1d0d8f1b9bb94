"""Batch builds of all recommendation lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluation import compare_algorithms, conclusion, weight_experiment
from ..operators.recommend import RECOMMENDERS, recommend
from ..settings import EvaluationSettings, RecommendSettings
from ..sources.tables import run_record, write_json, write_table


def batch_recommendations(behaviors: DataFrame, items: DataFrame, orders: DataFrame, order_items: DataFrame,
                          users: DataFrame, cfg: RecommendSettings = RecommendSettings(),
                          algorithms=tuple(RECOMMENDERS)) -> DataFrame:
    """Top-K of every algorithm for every user given, with an ``algorithm`` column."""
    return reduce(DataFrame.unionByName, [
        recommend(a, behaviors, items, orders, order_items, users, cfg).select(F.lit(a).alias("algorithm"), "*")
        for a in algorithms])


def run_recommendations(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str,
                        cfg: RecommendSettings = RecommendSettings(),
                        evaluation: EvaluationSettings = EvaluationSettings()) -> DataFrame:
    """Write the lists (one folder per algorithm), both comparisons and the run record."""
    behaviors, items = tables["user_behaviors"], tables["items"]
    orders, lines = tables["orders"], tables["order_items"]
    users = behaviors.select("user_id").distinct()
    for name in RECOMMENDERS:
        lists = recommend(name, behaviors, items, orders, lines, users, cfg)
        write_table(lists, f"{out_dir}/lists/algorithm={name}")
    write_json(weight_experiment(behaviors, items, orders, lines, evaluation, cfg), f"{out_dir}/weight_experiment")
    compared = compare_algorithms(behaviors, items, orders, lines, evaluation, cfg)
    write_json(compared, f"{out_dir}/comparison")
    write_json(conclusion(spark.read.schema(compared.schema).json(f"{out_dir}/comparison")), f"{out_dir}/conclusion")
    record = run_record(spark, job="recommendations", top_k=cfg.top_k, half_life_days=cfg.half_life_days,
                        weights=cfg.weights, blend=cfg.blend, neighbors=cfg.neighbors)
    write_json(record, f"{out_dir}/run_record")
    return record
