"""Purchase and churn models: panel, split, fit, evaluate, save and score."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..operators.models import best_model, score_latest_per_user, score_latest_snapshot, train_and_evaluate
from ..operators.snapshots import churn_dataset, purchase_dataset, snapshot_ends, time_split
from ..settings import ModelSettings, SnapshotSettings
from ..sources.tables import run_record, write_json, write_table


def save_models(models: dict[str, PipelineModel], folder: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{folder}/{name}")


def load_model(folder: str, name: str) -> PipelineModel:
    return PipelineModel.load(f"{folder}/{name}")


def run_models(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str, task: str,
               panel: SnapshotSettings | None = None, cfg: ModelSettings = ModelSettings()) -> DataFrame:
    """``task`` is ``purchase`` or ``churn``.  The panel is written once and everything reads that."""
    build = {"purchase": purchase_dataset, "churn": churn_dataset}[task]
    panel = panel or SnapshotSettings(label_days=7 if task == "purchase" else 30)
    days = snapshot_ends(tables["user_behaviors"], panel)
    dataset = build(tables["users"], tables["user_behaviors"], tables["orders"], tables["order_items"], tables["items"], panel)
    write_table(time_split(dataset, cfg.val_ratio, cfg.test_ratio, days), f"{out_dir}/dataset")
    split = spark.read.parquet(f"{out_dir}/dataset")
    models, metrics, importance = train_and_evaluate(split, cfg)
    save_models(models, f"{out_dir}/models")
    write_json(metrics, f"{out_dir}/metrics")
    write_json(best_model(spark.read.schema(metrics.schema).json(f"{out_dir}/metrics")), f"{out_dir}/best_model")
    write_json(importance, f"{out_dir}/feature_importance")
    scorer = score_latest_per_user if task == "purchase" else lambda m, d: score_latest_snapshot(m, d, cfg)
    write_table(scorer(models["logistic_regression"], split), f"{out_dir}/scores")
    record = run_record(spark, job=f"{task}_model", observation_days=panel.observation_days, label_days=panel.label_days,
                        step_days=panel.step_days, trees=cfg.trees, seed=cfg.seed)
    write_json(record, f"{out_dir}/run_record")
    return record
