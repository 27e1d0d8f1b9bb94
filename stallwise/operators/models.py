"""Classifiers on snapshot panels, their metrics, and scores for the latest users."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import cents, first_rule, safe_div, scalar_row, type_counts
from ..functions.sequence import even_buckets, running_total
from ..session import cut_lineage, scratch_path
from ..settings import CLUSTER_RULES, ModelSettings
from .features import USER_FEATURES
from .revenue import paid_orders

CLUSTER_FEATURES = ("total_pv", "total_click", "total_buy", "total_amount", "avg_order_amount",
                    "purchase_frequency", "recency")


def _numeric(dataset: DataFrame) -> DataFrame:
    return dataset.fillna(0, subset=list(USER_FEATURES)).withColumns(
        {c: F.col(c).cast("double") for c in USER_FEATURES})


def balanced_weights(train: DataFrame) -> DataFrame:
    """Weight n / (2 * class size), so both classes carry the same total."""
    totals = scalar_row(train, n=F.count(F.lit(1)), pos=F.sum("label"))
    size = F.when(F.col("label") == 1, totals["pos"]).otherwise(totals["n"] - totals["pos"])
    return train.withColumn("class_weight", totals["n"] / (size * 2.0))


def without_summary(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The model with its last stage as it reads back from the shared folder, which is all that scoring needs.

    A fitted classifier keeps a summary of its training, and with it the session.  Scoring ships the classifier to the tasks, which
    fails from the session's first observed write on: what a session keeps for observations cannot be serialised.
    """
    last = model.stages[-1]
    if not last.hasSummary:
        return model
    path = scratch_path(spark, "fitted")
    last.save(path)
    return PipelineModel(stages=[*model.stages[:-1], type(last).load(path)])


def fit_models(train: DataFrame, cfg: ModelSettings = ModelSettings(), only: str | None = None) -> dict[str, PipelineModel]:
    """Logistic regression on standardised features and a random forest, both class-balanced.

    Both pass over ``train`` many times, so hand in a table that is already written.
    """
    data = balanced_weights(_numeric(train)).select("label", "class_weight", *USER_FEATURES)
    total = data.agg(F.sum("class_weight")).first()[0]
    assemble = VectorAssembler(inputCols=list(USER_FEATURES), outputCol="raw")
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    logistic = LogisticRegression(
        labelCol="label", weightCol="class_weight", maxIter=cfg.max_iter, standardization=False,
        regParam=1.0 / (cfg.inverse_penalty * total))
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="raw", weightCol="class_weight", numTrees=cfg.trees,
        maxDepth=cfg.max_depth, seed=cfg.seed, cacheNodeIds=False)
    stages = {"logistic_regression": [assemble, scale, logistic], "random_forest": [assemble, forest]}
    return {name: without_summary(Pipeline(stages=s).fit(data), data.sparkSession)
            for name, s in stages.items() if only in (None, name)}


def score(model: PipelineModel, dataset: DataFrame, keep: tuple[str, ...] = ("user_id", "obs_end", "label")) -> DataFrame:
    scored = model.transform(_numeric(dataset))
    kept = [c for c in (*keep, "split") if c in dataset.columns]
    # A model trained on negatives alone knows one class and gives no second entry.
    positive = F.coalesce(F.get(vector_to_array("probability"), 1), F.lit(0.0))
    return scored.select(*kept, positive.alias("probability"))


def classification_metrics(scored: DataFrame, by: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """Counts, rates and exact ROC and precision-recall areas per group of ``by``.

    Equal scores are merged first, then cumulative counts run inside score buckets, so no task sorts
    all scores.  Areas are null where only one class is present.
    """
    hit = F.col("probability") >= threshold
    real = F.col("label") == 1
    by_score = scored.groupBy(*by, "probability").agg(
        F.count_if(real).alias("pos"), F.count_if(~real).alias("neg"),
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"))
    even = even_buckets(by_score, [F.desc("probability"), *[F.col(c) for c in by]])
    cumulative = running_total(even, "bucket", [F.desc("probability")], ["pos", "neg"], by)
    pair_area = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    precision_area = F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    sums = cumulative.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("pos", "neg", "tp", "fp")],
        F.sum(pair_area).alias("pair_area"), F.sum(precision_area).alias("precision_area"))
    n = F.col("pos") + F.col("neg")
    fn, tn = F.col("pos") - F.col("tp"), F.col("neg") - F.col("fp")
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return sums.select(
        *by, n.alias("n_samples"), F.col("pos").alias("n_positive"), safe_div("pos", n).alias("positive_rate"),
        safe_div(F.col("tp") + tn, n).alias("accuracy"), safe_div("tp", F.col("tp") + F.col("fp")).alias("precision"),
        safe_div("tp", "pos").alias("recall"),
        safe_div(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + fn).alias("f1"),
        F.when(both, F.round(F.col("pair_area") / (F.col("pos").cast("double") * F.col("neg")), 4)).alias("roc_auc"),
        F.when(both, F.round(F.col("precision_area") / F.col("pos"), 4)).alias("pr_auc"),
        tn.alias("tn"), F.col("fp").alias("fp"), fn.alias("fn"), F.col("tp").alias("tp"))


def train_and_evaluate(split: DataFrame, cfg: ModelSettings = ModelSettings()) -> tuple[dict, DataFrame, DataFrame]:
    """Fit on ``train``; metrics for ``val`` and ``test`` of both models, and feature importance."""
    split = cut_lineage(split)
    models = fit_models(split.filter("split = 'train'"), cfg)
    held_out = split.filter("split <> 'train'")
    scored = None
    for name, model in models.items():
        part = score(model, held_out).withColumn("model", F.lit(name))
        scored = part if scored is None else scored.unionByName(part)
    return models, classification_metrics(scored, ("model", "split")), feature_importance(models, split.sparkSession)


def feature_importance(models: dict[str, PipelineModel], spark, top_n: int = 20) -> DataFrame:
    rows = []
    for name, model in models.items():
        last = model.stages[-1]
        values = last.featureImportances if name == "random_forest" else last.coefficients
        rows += [(name, f, float(v), abs(float(v))) for f, v in zip(USER_FEATURES, values.toArray())]
    table = spark.createDataFrame(rows, "model string, feature string, value double, magnitude double")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("magnitude"), "feature"))
    return table.withColumn("rank", place).filter(F.col("rank") <= top_n).select(
        "model", "rank", "feature", F.round("value", 4).alias("value"), F.round("magnitude", 4).alias("magnitude"))


def risk_level(probability, low: float = 0.3, high: float = 0.7) -> Column:
    return F.when(probability < low, "low").when(probability > high, "high").otherwise("medium")


def score_latest_snapshot(model: PipelineModel, dataset: DataFrame, cfg: ModelSettings = ModelSettings()) -> DataFrame:
    """Churn risk of everybody in the last snapshot."""
    last = scalar_row(dataset, e=F.max("obs_end"))["e"]
    scored = score(model, dataset.filter(F.col("obs_end") == last))
    return scored.select("user_id", "obs_end", F.round("probability", 4).alias("churn_probability"),
                         risk_level(F.col("probability"), cfg.risk_low, cfg.risk_high).alias("risk_level"))


def latest_per_user(dataset: DataFrame) -> DataFrame:
    columns = dataset.columns
    return dataset.groupBy("user_id").agg(F.max_by(F.struct(*columns), "obs_end").alias("_r")).select("_r.*")


def score_latest_per_user(model: PipelineModel, dataset: DataFrame) -> DataFrame:
    """Purchase probability of every user at their own latest snapshot."""
    return score(model, latest_per_user(dataset)).select(
        "user_id", "obs_end", F.round("probability", 4).alias("purchase_probability"))


def best_model(metrics: DataFrame) -> DataFrame:
    """The model with the higher test PR area."""
    return metrics.filter("split = 'test'").agg(
        F.max_by("model", F.struct("pr_auc", "model")).alias("best_model"), F.max("pr_auc").alias("pr_auc"))


def segmentation_features(behaviors: DataFrame, orders: DataFrame) -> DataFrame:
    dated = behaviors.filter(F.col("event_date").isNotNull())
    per_user = dated.groupBy("user_id").agg(*type_counts(), F.max("event_date").alias("last"))
    as_of = scalar_row(per_user, d=F.max("last"))["d"]
    paid = paid_orders(orders).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("purchase_frequency"), cents(F.sum("total_amount")).alias("total_amount"))
    return (
        per_user.join(paid, "user_id", "left").fillna(0, subset=["purchase_frequency", "total_amount"])
        .select("user_id", F.col("pv").alias("total_pv"), F.col("click").alias("total_click"),
                F.col("buy").alias("total_buy"), "total_amount",
                safe_div("total_amount", "purchase_frequency").alias("avg_order_amount"), "purchase_frequency",
                F.datediff(as_of, "last").alias("recency"))
    )


def assign_clusters(features: DataFrame, k: int = 4, starts: int = 10, seed: int = 42) -> DataFrame:
    """KMeans on standardised features, best of several starts, clusters numbered by size."""
    data = cut_lineage(features)
    k = min(k, data.limit(k).count())
    assembled = VectorAssembler(inputCols=list(CLUSTER_FEATURES), outputCol="raw").transform(data)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(assembled)
    scaled = scaler.transform(assembled)
    if k < 2:
        labelled = scaled.withColumn("label", F.lit(0))
    else:
        fits = [KMeans(k=k, seed=seed + i).fit(scaled) for i in range(starts)]
        labelled = min(fits, key=lambda m: m.summary.trainingCost).transform(scaled).withColumnRenamed("prediction", "label")
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    by_size = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "label")))
    order = sizes.agg(F.transform(by_size, lambda x: x["label"]).alias("labels")).scalar()
    place = F.array_position(order, F.col("label")) - 1
    return labelled.select("user_id", place.alias("cluster_id"), *CLUSTER_FEATURES)


def name_clusters(assigned: DataFrame) -> DataFrame:
    """Size, share, means and the rule-given name per cluster."""
    total = scalar_row(assigned, n=F.count(F.lit(1)))["n"]
    means = [F.round(F.avg(c), 1 if c == "recency" else 4).alias(c) for c in CLUSTER_FEATURES]
    return assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), *means).withColumns({
        "ratio": safe_div("size", total), "cluster_name": first_rule(CLUSTER_RULES)})
