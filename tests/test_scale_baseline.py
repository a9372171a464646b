"""Baselines that score in any session and send no row to Python."""

import numpy as np
import pytest
from pyspark.sql import Observation, functions as F

from credence.functions.text import NONWS, word_count
from credence.operators import classify, experiments
from credence.operators import tfidf as T


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _texts(spark, n=40):
    words = "vaccine cure study trial doctor secret caf\u00e9 data report claim".split()
    rows = [(f"d{i}", " ".join(words[(i * j + i) % 10] for j in range(3 + i % 9)), i % 3 % 2) for i in range(n)]
    return spark.createDataFrame([*rows, ("e", "", 1), ("n", None, 0)], "id string, text string, label int")


def test_scoring_beside_an_open_observation(spark):
    """a query that observes rows and has not run yet must not keep a fitted model from scoring."""
    df = _texts(spark)
    model = classify.build_baseline(max_features=20).fit(df)
    seen = Observation()
    waiting = spark.range(3).observe(seen, F.count(F.lit(1)).alias("n"))
    assert model.predict(df).count() == 42
    assert all(0 < r["score"] < 1 for r in model.predict(df).collect())
    assert waiting.count() == 3 and seen.get["n"] == 3


def test_baselines_are_fitted_and_scored_without_python_rows(spark):
    """Vectors are written as structs and read as vectors; scores equal those of the MLlib model."""
    df = _texts(spark).where("text is null or text not like '%\u00e9%'")
    model = classify.build_baseline(max_features=20).fit(df)
    assert "ArrowEvalPython" not in _plan(model.predict(df))
    vectors = T.tfidf_vectors(df, "text", model.tfidf, sign=F.lit(1.0))
    again = T.staged_vectors(df, "text", model.tfidf, "vectors", sign=F.lit(1.0))
    assert again.schema["features"].dataType == vectors.schema["features"].dataType
    assert {r["id"]: r["features"] for r in again.collect()} == {r["id"]: r["features"] for r in vectors.collect()}
    weights = model.model.coefficients.toArray()
    margin = {r["id"]: r["features"].toArray() @ weights for r in vectors.collect()}
    for r in model.predict(df).collect():
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-margin[r["id"]])), abs=1e-12)
        assert r["prediction"] == int(margin[r["id"]] > 0)


@pytest.mark.parametrize("per_feature", [4, 20])
def test_few_passes_reach_the_minimum(spark, monkeypatch, per_feature):
    """the passes over the rows do not run into hundreds, also where the steps know a part of the rows only."""
    from credence.operators import logistic

    monkeypatch.setattr(logistic, "PER_FEATURE", per_feature)
    rng = np.random.default_rng(3)
    n, width = 600, 40
    x = (rng.random((n, width)) < 0.03 + 0.5 ** np.arange(width)) * 1.0
    x[:, -1] = 1.0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    target = np.where(x @ rng.normal(size=width) * 4 + rng.normal(size=n) > 0, 1.0, -1.0)
    weight = np.where(target > 0, 0.4, 3.0)
    rows = [(np.flatnonzero(r).tolist(), r[r != 0].tolist(), float(t), float(w)) for r, t, w in zip(x, target, weight)]
    frame = spark.createDataFrame(rows, "indices array<int>, values array<double>, target double, weight double").repartition(4)
    found, passes = logistic.minimise(frame, width, n, 2.0, 200)
    scale = 2.0 * n / weight.sum()
    gradient = found - scale * x.T @ (weight * target / (1 + np.exp(target * (x @ found))))
    assert np.linalg.norm(gradient) < 1e-6
    assert passes <= 30


def _metrics_read(spark, metrics):
    """Result of ``metrics`` and how many rows it had scored for it."""
    scored = spark.sparkContext.accumulator(0)

    def score(x):
        scored.add(1)
        return x / 40

    rows = spark.range(40).select(
        F.when(F.col("id") < 30, "a").otherwise("b").alias("dataset"), (F.col("id") % 2).cast("int").alias("label"),
        F.udf(score, "double")("id").alias("score"),
    ).withColumn("prediction", F.col("label"))
    return metrics(rows).collect(), scored.value


def test_zero_shot_scores_a_row_once(spark):
    """F1: the metrics read their rows several times; the target was scored as often."""
    found, scored = _metrics_read(spark, experiments.zero_shot_metrics)
    assert {r["dataset"]: (r["n"], r["accuracy"]) for r in found} == {"a": (30, 1.0), "b": (10, 1.0)}
    assert scored == 40


def test_word_count_does_not_run_over_a_complement(spark):
    """Java takes some ten times as long over runs of what is no whitespace."""
    count = word_count("s")
    samples = ["", " ", "\t \n", "a", " a  b　c\x1cd ", "a​b c", "\x85x\xa0", "<b> x", None]
    counted = spark.createDataFrame([(s,) for s in samples], "s string").select("s", count.alias("n"))
    assert NONWS not in _plan(counted)
    assert [r["n"] for r in counted.collect()] == [None if s is None else len(s.split()) for s in samples]


def test_two_baselines_cut_the_texts_once(spark, monkeypatch):
    """F2: training vectors are written once for both models, and both score what was cut into terms once."""
    written = []
    staged = classify.staged_entries
    monkeypatch.setattr(classify, "staged_entries", lambda *a: written.append(1) or staged(*a))
    parts = ("train", "train", "validation", "test")
    rows = [(*r, parts[i % 4]) for i, r in enumerate(_texts(spark).collect())]
    df = spark.createDataFrame(rows, "id string, text string, label int, split string")
    found = experiments.imbalance_predictions(df, max_features=20)
    assert len(written) == 1 and _plan(found).count("UDF(_grams") == 1
    train, held_out = df.where("split = 'train'"), df.where("split <> 'train'")
    for name, build in (("Unweighted", classify.build_baseline), ("Class weighted", classify.build_balanced_baseline)):
        one = {(r["id"], r["prediction"], round(r["score"], 9)) for r in build(max_features=20).fit(train).predict(held_out).collect()}
        assert one == {(r["id"], r["prediction"], round(r["score"], 9)) for r in found.where(F.col("model") == name).collect()}
