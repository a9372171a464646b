"""One run from processed rows to all its report files.

    <out>/splits                         processed rows with their part, in folders by part
    <out>/baseline_comparison.csv        both text baselines on validation and test
    <out>/baseline_metrics.csv           the class-weighted baseline on test
    <out>/feature_metadata.csv           sizes of the text and context features
    <out>/final_model_metrics.csv        the gated model on test: overall, with and without context
    <out>/missing_context_metrics.csv    its metrics with and without context side by side
    <out>/model_comparison.csv           the gated model beside the baseline
    <out>/final_model                    its weights
    <out>/final_model_config.json        the settings of the run

Tables that are read more than once are staged; every report is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from credence.operators import experiments, metrics
from credence.operators.context import ContextModel, feature_count
from credence.operators.fusion import CONFIG, FittedFusion, FusionShape, train_fusion
from credence.operators.sparse import width
from credence.operators.split import split_labeled_data
from credence.operators.tfidf import MAX_FEATURES, TfidfModel, fit_tfidf
from credence.session import stage
from credence.sources.tables import save_config

# ---- fixed values: names of the files -----------------------------------------
BASELINE_REPORT, COMPARISON_REPORT = "baseline_metrics", "model_comparison"
METADATA_REPORT, CONFIG_FILE = "feature_metadata", "final_model_config.json"
# -----------------------------------------------------------------------------
CHOICE_REPORT, SPLITS, MODEL = "baseline_comparison", "splits", "final_model"


def _write(frame: DataFrame, out_dir: str, name: str) -> None:
    """A report of a few rows as one CSV file."""
    frame.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out_dir}/{name}.csv")


def feature_metadata(text: TfidfModel, context: ContextModel, masked: DataFrame, mask="context_available") -> DataFrame:
    """One row: numbers of text and context features, rows with context, and all rows."""
    return masked.agg(
        F.lit(len(text.terms)).cast("long").alias("text_feature_count"),
        F.lit(feature_count(context)).cast("long").alias("context_feature_count"),
        F.coalesce(F.sum(F.col(mask).cast("long")), F.lit(0)).alias("context_rows_available"),
        F.count("*").alias("total_rows"),
    )


def write_feature_metadata(text: TfidfModel, context: ContextModel, masked: DataFrame, out_dir: str, mask="context_available") -> None:
    _write(feature_metadata(text, context, masked, mask), out_dir, METADATA_REPORT)


def run_baselines(processed: DataFrame, out_dir: str, *, seed=CONFIG["seed"], max_features=MAX_FEATURES) -> DataFrame:
    """Splits, both baselines on validation and test, and the class-weighted one's metrics on test, all written; returns the splits."""
    spark = processed.sparkSession
    parts = split_labeled_data(processed, text_column="text", label_column="label", random_state=seed)
    parts.write.mode("overwrite").partitionBy("split").parquet(f"{out_dir}/{SPLITS}")
    parts = spark.read.parquet(f"{out_dir}/{SPLITS}")
    predicted = stage(experiments.imbalance_predictions(parts, max_features=max_features), "baseline-predictions")
    _write(metrics.binary_metrics(predicted, by=["part", "model"]).orderBy(F.desc("part"), F.desc("model")), out_dir, CHOICE_REPORT)
    weighted = predicted.where((F.col("part") == "test") & (F.col("model") == experiments.WEIGHTED_NAME))
    experiments.write_baseline_metrics(metrics.binary_metrics(weighted), f"{out_dir}/{BASELINE_REPORT}.csv")
    return parts


def run_gated_model(inputs: DataFrame, parts: DataFrame, out_dir: str, *, config: dict | None = None) -> tuple[FittedFusion, DataFrame]:
    """The gated model trained on the training part of ``inputs`` (the rows of ``parts`` by id), its reports on the test part
    written beside the baseline's; returns the model and the scored test rows."""
    spark = inputs.sparkSession
    config = {**CONFIG, **(config or {})}
    rows = stage(inputs.join(parts.select("id", "split"), "id"), "gated-inputs")
    dims = rows.select(F.size("text_features").alias("t"), width(rows, "context_features").alias("c")).first()
    if dims is None:
        raise ValueError("no feature row has an id of the splits")
    shape = FusionShape(dims["t"], dims["c"], config["hidden_dim"], config["num_classes"])
    model, _ = train_fusion(
        rows.where("split = 'train'"), rows.where("split = 'validation'"), shape, epochs=config["num_epochs"],
        patience=config["patience"], learning_rate=config["learning_rate"], dropout=config["dropout"], seed=config["seed"],
        batch_size=config["batch_size"],
    )
    scored = stage(model.score(rows.where("split = 'test'")).drop("probabilities", "logits"), "gated-test")
    final = experiments.final_metrics(scored)
    experiments.write_reports(final, experiments.missing_context(scored), out_dir)
    overall = experiments.metrics_long(final.where("experiment = 'overall'"), experiments.WEIGHTED)
    baseline = experiments.read_baseline_metrics(spark, f"{out_dir}/{BASELINE_REPORT}.csv")
    _write(experiments.compare_with_baseline(overall, baseline), out_dir, COMPARISON_REPORT)
    model.save(spark, f"{out_dir}/{MODEL}")
    save_config(spark, config, f"{out_dir}/{CONFIG_FILE}")
    return model, scored


def run_all(
    processed: DataFrame, inputs: DataFrame, context: ContextModel, masked: DataFrame, out_dir: str, *, config: dict | None = None,
    max_features=MAX_FEATURES,
) -> tuple[FittedFusion, DataFrame]:
    """All reports of this module from processed rows and the model inputs of the same ids."""
    seed = {**CONFIG, **(config or {})}["seed"]
    parts = run_baselines(processed, out_dir, seed=seed, max_features=max_features)
    text = fit_tfidf(parts.where("split = 'train'"), "text", max_features=max_features)
    write_feature_metadata(text, context, masked, out_dir)
    return run_gated_model(inputs, parts, out_dir, config=config)
