"""Streams against their batch forms, and models on a written panel."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stallwise.operators.models import CLUSTER_FEATURES, assign_clusters, fit_models, name_clusters, risk_level, score
from stallwise.operators.features import USER_FEATURES
from stallwise.operators.paths import session_starts
from stallwise.plans.prediction import load_model, save_models
from stallwise.settings import ModelSettings
from stallwise.sources.tables import write_measured
from stallwise.sources.worlds import event_columns
from stallwise.streaming import indicators as S

T0 = datetime(2024, 1, 1)


def _events(spark, rows):
    full = [(i, T0 + timedelta(minutes=m), u, t, 1.0, '{"k": 1}') for i, (m, u, t) in enumerate(rows)]
    return spark.createDataFrame(full, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_stream_sessions_equal_batch_sessions(spark, tmp_path):
    """Gaps of exactly 30 minutes merge in both; the last event only moves the watermark."""
    minutes = [0, 30, 61, 62, 92, 200, 1000]
    events = _events(spark, [(m, 7, "view") for m in minutes] + [(20000, 9, "view")])
    events.write.parquet(str(tmp_path / "in"))
    stream = S.event_stream(spark, str(tmp_path / "in"), "*.parquet")
    got = {(r["user_id"], r["session_start"]): r["events"] for r in S.run_available(S.user_sessions(S.behavior_stream(stream))).collect()}
    batch = session_starts(event_columns(events)).groupBy("user_id", "session_start").count().filter("user_id = 7")
    assert got == {(r["user_id"], r["session_start"]): r["count"] for r in batch.collect()}


def test_late_rows_are_dropped_and_duplicates_once(spark, tmp_path):
    folder = tmp_path / "in"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def arrive(rows, n):
        _events(spark, rows).coalesce(1).write.parquet(str(folder / f"day={n}"))

    def run():
        stream = spark.readStream.schema(_events(spark, [(0, 1, "view")]).schema).option("recursiveFileLookup", True).parquet(str(folder))
        return S.run_available(S.page_views(S.behavior_stream(stream)), out, state)
    arrive([(10, 1, "view"), (600, 1, "view")], 1)
    run()
    arrive([(15, 1, "view"), (1200, 1, "view")], 2)  # minute 15 lies before the watermark by now
    rows = {r["window_start"]: r["pv"] for r in run().collect()}
    assert rows[T0] == 1
    twice = _events(spark, [(0, 1, "view"), (1, 1, "view")])
    twice.unionByName(twice).coalesce(1).write.parquet(str(tmp_path / "dup"))
    stream = S.event_stream(spark, str(tmp_path / "dup"), "*.parquet")
    assert S.run_available(S.deduplicated(S.behavior_stream(stream))).count() == 2


def _panel(spark, n=400):
    df = spark.range(n).select((F.col("id") % 2).cast("int").alias("label"), F.col("id").alias("user_id"), F.lit("2024-01-01").alias("obs_end"))
    noise = {c: (F.hash("user_id", F.lit(c)) % 100) / 100.0 for c in USER_FEATURES}
    noise["n_buy"] = F.col("label") * 3 + (F.hash("user_id") % 100) / 100.0
    return df.withColumns(noise)


def test_models_learn_save_and_load(spark, tmp_path):
    path = str(tmp_path / "panel")
    _panel(spark).write.parquet(path)
    panel = spark.read.parquet(path)
    models = fit_models(panel, ModelSettings(trees=5, max_depth=3, max_iter=20))
    save_models(models, str(tmp_path / "models"))
    for name in models:
        scored = score(load_model(str(tmp_path / "models"), name), panel)
        right = scored.filter((F.col("probability") >= 0.5).cast("int") == F.col("label")).count()
        assert right > 380
    levels = spark.createDataFrame([(0.29,), (0.3,), (0.7,), (0.71,)], "p double").select(risk_level(F.col("p")))
    assert [r[0] for r in levels.collect()] == ["low", "medium", "medium", "high"]


@pytest.mark.parametrize("classes", [1, 2])
def test_models_score_after_an_observed_write(spark, tmp_path, classes):
    """What the session keeps for observations must not travel to the tasks with a model."""
    path = str(tmp_path / "panel")
    assert write_measured(_panel(spark).withColumn("label", F.col("label") % classes), path)["rows"] == 400
    panel = spark.read.parquet(path)
    for name, model in fit_models(panel, ModelSettings(trees=5, max_depth=3, max_iter=20)).items():
        scored = score(model, panel).groupBy("label").agg(F.count_if(F.col("probability").between(0, 1)).alias("n"))
        assert {r["label"]: r["n"] for r in scored.collect()} == ({0: 400} if classes == 1 else {0: 200, 1: 200}), name


def test_clusters_are_numbered_by_size(spark):
    rows = [(i, *([float(1 if i < 30 else 100)] * len(CLUSTER_FEATURES))) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id long, " + ", ".join(f"{c} double" for c in CLUSTER_FEATURES))
    assigned = assign_clusters(df, k=2, starts=2)
    sizes = {r["cluster_id"]: (r["size"], r["cluster_name"]) for r in name_clusters(assigned).collect()}
    assert sizes[0][0] == 30 and sizes[1][0] == 10
