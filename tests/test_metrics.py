import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.operators import experiments as X
from credence.operators import metrics as M


def _frame(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, score double").repartition(4)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    score = np.round(rng.random(400), 2)
    label = (rng.random(400) < 0.2 + 0.4 * score).astype(int)
    return [(int(y), int(s >= 0.5), float(s)) for y, s in zip(label, score)]


def brute_auc(rows):
    pos = [s for y, _, s in rows if y == 1]
    neg = [s for y, _, s in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    total, last, positives = 0.0, 0.0, sum(y for y, *_ in rows)
    for t in sorted({s for *_, s in rows}, reverse=True):
        called = [y for y, _, s in rows if s >= t]
        recall = sum(called) / positives
        total += (recall - last) * sum(called) / len(called)
        last = recall
    return total


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_areas(spark, sample, ranges):
    df = _frame(spark, sample)
    assert M.roc_auc(df, ranges=ranges).first()[0] == pytest.approx(brute_auc(sample))
    assert M.average_precision(df, ranges=ranges).first()[0] == pytest.approx(brute_ap(sample))


def test_areas_ignore_monotone_maps(spark, sample):
    df = _frame(spark, sample)
    moved = df.withColumn("score", F.exp(F.col("score") * 3) - 7)
    assert M.roc_auc(moved).first()[0] == pytest.approx(M.roc_auc(df).first()[0])


def test_clustered_scores(spark):
    """Distinct scores in a tiny interval still spread over the ranges."""
    rng = np.random.default_rng(1)
    rows = [(int(rng.random() < 0.5), 1, float(0.999 + rng.random() * 1e-6)) for _ in range(300)]
    assert M.roc_auc(_frame(spark, rows), ranges=16).first()[0] == pytest.approx(brute_auc(rows))


def test_binary_metrics(spark, sample):
    r = M.binary_metrics(_frame(spark, sample)).first()
    tp = sum(y and p for y, p, _ in sample)
    called = sum(p for _, p, _ in sample)
    positives = sum(y for y, *_ in sample)
    assert r["n"] == 400 and r["positive_count"] == positives
    assert r["accuracy"] == pytest.approx(sum(y == p for y, p, _ in sample) / 400)
    assert r["precision"] == pytest.approx(tp / called) and r["recall"] == pytest.approx(tp / positives)
    assert r["f1"] == pytest.approx(2 * tp / (called + positives))


def test_edges(spark):
    one_class = M.binary_metrics(_frame(spark, [(1, 1, 0.9), (1, 0, 0.1)])).first()
    assert one_class["roc_auc"] is None and one_class["average_precision"] is None
    tied = [(1, 1, 0.5), (0, 1, 0.5), (0, 1, 0.5)]
    assert M.roc_auc(_frame(spark, tied)).first()[0] == 0.5
    none_called = M.binary_metrics(_frame(spark, [(1, 0, 0.2), (0, 0, 0.1)])).first()
    assert none_called["precision"] == 0 and none_called["f1"] == 0
    cells = {(r["label"], r["prediction"]): r["n"] for r in M.confusion(_frame(spark, tied), [0, 1]).collect()}
    assert cells == {(0, 0): 0, (0, 1): 2, (1, 0): 0, (1, 1): 1}


def test_string_labels_and_contract(spark):
    df = spark.createDataFrame(
        [("fake", "fake", 0.9), ("real", "fake", 0.6), ("real", "real", 0.2)],
        "label string, prediction string, score double")
    call = lambda d, **kw: M.evaluate_binary_classifier(
        d, **{"classes": ["fake", "real"], "positive_label": "fake", "name": "m", **kw})
    r = call(df).first()
    assert (r["name"], r["n"], r["positive_count"], r["recall"], r["precision"]) == ("m", 3, 1, 1.0, 0.5)
    for bad in ({"positive_label": "no"}, {"classes": ["fake"]}, {"classes": ["fake", "other"]}):
        with pytest.raises(ValueError):
            call(df, **bad)
    with pytest.raises(ValueError):
        call(df.where("score > 2"))


def test_weighted_three_classes(spark):
    y = [0, 0, 1, 1, 2, 2, 2]
    p = [0, 1, 1, 1, 2, 0, 3]
    df = spark.createDataFrame(list(zip(y, p)), "label int, prediction int")
    r = M.weighted_metrics(df).first()
    assert r["accuracy"] == pytest.approx(4 / 7) == r["recall"]
    assert r["precision"] == pytest.approx((2 * 0.5 + 2 * (2 / 3) + 3 * 1.0) / 7)
    report = {x["class"]: x for x in M.class_report(df).collect()}
    assert report["3"]["support"] == 0 and report["3"]["recall"] == 0
    assert report["macro avg"]["recall"] == pytest.approx((0.5 + 1 + 1 / 3 + 0) / 4)
    assert report["weighted avg"]["f1"] == pytest.approx(r["f1"])


def test_curves(spark, sample):
    df = _frame(spark, sample)
    roc = sorted((r["fpr"], r["tpr"]) for r in M.roc_points(df).collect())
    assert roc[0] == (0.0, 0.0) and roc[-1] == (1.0, 1.0)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(roc, roc[1:]))
    assert area == pytest.approx(brute_auc(sample))
    pr = M.pr_points(df).collect()
    assert len(pr) == len({s for *_, s in sample}) + 1
    assert [(r["precision"], r["recall"]) for r in pr if r["threshold"] is None] == [(1.0, 0.0)]


def test_experiments(spark, sample):
    rows = [(*r, i % 3 == 0) for i, r in enumerate(sample)]
    df = spark.createDataFrame(rows, "label int, prediction int, score double, m boolean")
    df = df.withColumn("context_mask", F.col("m").cast("int"))
    final = {r["experiment"]: r for r in X.final_metrics(df).collect()}
    assert set(final) == {"overall", "context_available", "context_missing"}
    for name, keep in (("overall", lambda m: True), ("context_available", bool), ("context_missing", lambda m: not m)):
        part = [r[:3] for r in rows if keep(r[3])]
        assert final[name]["n"] == len(part)
        assert final[name]["roc_auc"] == pytest.approx(brute_auc(part))
    table = {r["metric"]: r for r in X.missing_context(df).collect()}
    assert set(table) == set(X.WEIGHTED)
    assert table["f1"]["context_missing"] == pytest.approx(final["context_missing"]["f1"])
    # no rows without context: no row for that condition, and nothing to compare
    only = df.where("context_mask = 1")
    assert {r["experiment"] for r in X.final_metrics(only).collect()} == {"overall", "context_available"}
    assert X.missing_context(only).count() == 0


def test_report_files(spark, sample, tmp_path):
    rows = [(*r, i % 2) for i, r in enumerate(sample)]
    df = spark.createDataFrame(rows, "label int, prediction int, score double, context_mask int")
    X.write_reports(X.final_metrics(df), X.missing_context(df), str(tmp_path))
    assert spark.read.csv(f"{tmp_path}/final_model_metrics.csv", header=True).count() == 3
    assert spark.read.csv(f"{tmp_path}/missing_context_metrics.csv", header=True).count() == 5
