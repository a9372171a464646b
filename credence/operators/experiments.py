"""Experiments as grouped metric tables over prediction frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from credence.operators.classify import DEFAULT_C, build_balanced_baseline, build_baseline, fit_each, predict_each
from credence.operators.metrics import METRICS, binary_metrics, collapse, weighted_metrics
from credence.operators.tfidf import MAX_FEATURES
from credence.session import stage

# ---- fixed values -----------------------------------------------------------
WEIGHTED = ["accuracy", "precision", "recall", "f1", "roc_auc"]
PLAIN_NAME, WEIGHTED_NAME = "Unweighted", "Class weighted"
FINAL_REPORT, MISSING_REPORT = "final_model_metrics", "missing_context_metrics"
PARTS = ("validation", "test")
# -----------------------------------------------------------------------------


def metrics_long(metrics: DataFrame, names, by=()) -> DataFrame:
    """One row per metric; a metric without a value (one class) is left out."""
    by = list(by)
    return metrics.select(*by, *names).unpivot(by, list(names), "metric", "value").where(
        "value is not null"
    )


def model_comparison(predictions: DataFrame, **columns) -> DataFrame:
    """Positive-class metrics per ``model``: all models in one job."""
    return binary_metrics(predictions, by=["model"], **columns)


def _scored_once(predictions: DataFrame, columns) -> DataFrame:
    """What the metrics read of the predictions, staged: they read it several times, and scoring costs far more than a write."""
    kept = [c for c in predictions.columns if c in (*columns, "_n")]
    return stage(predictions.select(*kept), "scored")


def imbalance_predictions(split_df: DataFrame, *, id_column="id", text_column="text",
                          label_column="label", max_features=MAX_FEATURES, c=DEFAULT_C,
                          parts=PARTS) -> DataFrame:
    """Plain and class-weighted baselines fitted on one training part (and one
    vocabulary) and applied to the same held-out rows, marked by ``part``."""
    train = split_df.where(F.col("split") == "train")
    held_out = split_df.where(F.col("split").isin(*parts)).select(
        F.col("split").alias("part"), id_column, text_column, label_column
    )
    columns = dict(id_column=id_column, text_column=text_column, label_column=label_column)
    builders = {PLAIN_NAME: build_baseline, WEIGHTED_NAME: build_balanced_baseline}
    baselines = [build(max_features=max_features, c=c) for build in builders.values()]
    models = dict(zip(builders, fit_each(baselines, train, **columns), strict=True))
    return predict_each(models, held_out).select("part", "model", id_column, label_column, "prediction", "score")


def imbalance_experiment(split_df: DataFrame, **options) -> DataFrame:
    """Both models on validation and test, in the order the choice is made: by part, then model."""
    truth, by = options.get("label_column", "label"), ["part", "model"]
    predictions = _scored_once(imbalance_predictions(split_df, **options), [*by, truth, "prediction", "score"])
    return binary_metrics(predictions, truth=truth, by=by).orderBy(F.desc("part"), F.desc("model"))


def missing_context(predictions: DataFrame, mask="context_mask", **columns) -> DataFrame:
    """Metric by condition (context available / missing); a metric is listed when
    both conditions have it, and nothing is listed when a condition has no rows."""
    columns.setdefault("score", "score")
    long = metrics_long(weighted_metrics(predictions, by=[mask], **columns), WEIGHTED, [mask])
    wide = long.groupBy("metric").agg(
        F.max(F.when(F.col(mask) == 1, F.col("value"))).alias("context_available"),
        F.max(F.when(F.col(mask) == 0, F.col("value"))).alias("context_missing"),
    )
    return wide.where("context_available is not null and context_missing is not null")


def final_metrics(predictions: DataFrame, mask="context_mask", truth="label",
                  pred="prediction", score="score") -> DataFrame:
    """Rows ``overall``, ``context_available`` and ``context_missing``: counts are
    collapsed once and then assigned to the experiments they belong to."""
    cells = collapse(predictions, [mask, truth, pred, score])
    names = F.array(
        F.lit("overall"),
        F.when(F.col(mask) == 1, "context_available").otherwise("context_missing"),
    )
    cells = cells.withColumn("experiment", F.explode(names))
    return weighted_metrics(cells, truth, pred, score, by=["experiment"])


def compare_with_baseline(model_metrics: DataFrame, baseline_metrics: DataFrame) -> DataFrame:
    """``(metric, model, baseline)``; a metric the baseline lacks stays null."""
    ours = model_metrics.select("metric", F.col("value").alias("model"))
    theirs = baseline_metrics.select("metric", F.col("value").alias("baseline"))
    return ours.join(theirs, "metric", "left")


def write_baseline_metrics(metrics: DataFrame, path: str) -> None:
    """One row, one column per metric, as CSV."""
    metrics.select(*[c for c in METRICS if c in metrics.columns]).coalesce(1).write.mode(
        "overwrite"
    ).option("header", True).csv(path)


def read_baseline_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``(metric, value)`` of a file that ``write_baseline_metrics`` or another tool wrote."""
    row = spark.read.option("header", True).csv(path)
    names = [c for c in METRICS if c in row.columns]
    if not names:
        raise ValueError(f"no known metric among the columns {row.columns} of {path}")
    return metrics_long(row.select(*[F.col(c).cast("double").alias(c) for c in names]), names)


def zero_shot_metrics(scored_target: DataFrame, by=("dataset",), **columns) -> DataFrame:
    """Metrics of a source-trained model on target rows, per target dataset."""
    columns.setdefault("score", "score")
    read = [*by, columns.get("truth", "label"), columns.get("pred", "prediction"), columns["score"]]
    return weighted_metrics(_scored_once(scored_target, read), by=list(by), **columns)


def write_reports(final: DataFrame, missing: DataFrame, out_dir: str) -> None:
    """The two report tables as CSV."""
    for frame, name in ((final, FINAL_REPORT), (missing, MISSING_REPORT)):
        frame.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out_dir}/{name}.csv")
