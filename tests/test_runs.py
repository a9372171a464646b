"""One run that ends in all report files."""

import os

import pytest
from pyspark.sql import functions as F

from credence.operators import classify, context, experiments, fusion, metrics, runs, tfidf
from credence.plans import corpora, queries
from credence.sources.tables import load_config


def test_run_writes_every_report(spark, sf, tmp_path):
    processed = queries._processed(spark, sf)
    model_of_context = corpora.context_model(spark, sf)
    masked = context.context_availability(corpora.documents(spark, sf), queries.COUNT_COLUMNS)
    inputs = corpora.fusion_inputs(spark, sf)
    config = {"hidden_dim": 8, "num_epochs": 2}
    model, scored = runs.run_all(processed, inputs, model_of_context, masked, str(tmp_path), config=config, max_features=50)
    names = {
        "splits", "baseline_comparison.csv", "baseline_metrics.csv", "feature_metadata.csv", "final_model_metrics.csv",
        "missing_context_metrics.csv", "model_comparison.csv", "final_model", "final_model_config.json",
    }
    assert set(os.listdir(tmp_path)) == names
    report = lambda name: spark.read.option("header", True).csv(f"{tmp_path}/{name}.csv").collect()

    parts = spark.read.parquet(f"{tmp_path}/splits")
    assert parts.count() == processed.count() and parts.select("split").distinct().count() == 3
    choice = report("baseline_comparison")
    assert [(r["part"], r["model"]) for r in choice] == [
        (p, m) for p in ("validation", "test") for m in (experiments.PLAIN_NAME, experiments.WEIGHTED_NAME)
    ]
    # the reported baseline is the class-weighted one, fitted on the training part, on the test part
    plain = tfidf.fit_tfidf(parts.where("split = 'train'"), "text", max_features=50)
    fitted = classify.build_balanced_baseline(max_features=50).fit(parts.where("split = 'train'"), tfidf=plain)
    want = metrics.binary_metrics(fitted.predict(parts.where("split = 'test'"))).first()
    (baseline,) = report("baseline_metrics")
    assert float(baseline["accuracy"]) == pytest.approx(want["accuracy"]) and baseline["f1"] == choice[3]["f1"]

    (sizes,) = report("feature_metadata")
    assert int(sizes["text_feature_count"]) == len(plain.terms) and int(sizes["total_rows"]) == masked.count()
    assert int(sizes["context_feature_count"]) == context.feature_count(model_of_context)
    assert int(sizes["context_rows_available"]) == masked.where("context_available = 1").count()

    final = {r["experiment"]: r for r in report("final_model_metrics")}
    right = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert float(final["overall"]["accuracy"]) == pytest.approx(right)
    missing = {r["metric"]: r for r in report("missing_context_metrics")}
    assert float(missing["accuracy"]["context_missing"]) == pytest.approx(float(final["context_missing"]["accuracy"]))
    beside = {r["metric"]: r for r in report("model_comparison")}
    assert float(beside["accuracy"]["model"]) == pytest.approx(right)
    assert float(beside["accuracy"]["baseline"]) == pytest.approx(want["accuracy"])

    assert load_config(spark, f"{tmp_path}/final_model_config.json") == {**fusion.CONFIG, **config}
    again = fusion.FittedFusion.load(spark, f"{tmp_path}/final_model")
    assert again.shape == model.shape and (again.params == model.params).all()


def test_run_needs_rows_of_the_splits(spark, sf, tmp_path):
    parts = spark.createDataFrame([("nobody", "train")], "id string, split string")
    with pytest.raises(ValueError, match="no feature row"):
        runs.run_gated_model(corpora.fusion_inputs(spark, sf), parts, str(tmp_path))
