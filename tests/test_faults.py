"""Ordinary inputs that once gave wrong answers: NaN, null groups, one class, empty tables, repeated ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence import session
from credence.operators import classify, context, experiments, fusion, metrics, profile, split, tfidf
from credence.operators.sparse import SPARSE, SparseRows
from credence.session import staged
from credence.sources.delimited import read_delimited

NAN = float("nan")


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, NAN, "b"), (3, None, "a"), (4, 6.0, "a")], "id int, x double, s string")
    rows = {r["id"]: r["context_available"] for r in context.context_availability(df, ["x"]).collect()}
    assert rows == {1: 1, 2: 0, 3: 0, 4: 1}
    model = context.fit_context(df, numeric_columns=["x"])
    (_, median, mean, scale), = model.numeric
    assert (median, mean) == (4.0, 4.0) and scale == pytest.approx(2.0**0.5)
    values = {r["id"]: r["value"] for r in context.context_numeric(df, "id", model).collect()}
    assert values[2] == values[3] == 0.0
    only = df.withColumn("x", F.lit(NAN))
    assert context.fit_context(only, numeric_columns=["x"]).numeric == []
    missing = {r["column"]: r["missing"] for r in profile.profile_missing(df, ["x", "s"]).collect()}
    assert missing == {"x": 2, "s": 0}


def test_null_group_is_a_group(spark):
    rows = [("a", 1, 1, 0.9), ("a", 0, 0, 0.2), (None, 1, 0, 0.4), (None, 0, 0, 0.3), (None, 1, 1, 0.8)]
    df = spark.createDataFrame(rows, "g string, label int, prediction int, score double")
    plain = {r["g"]: r for r in metrics.binary_metrics(df, by=["g"]).collect()}
    assert plain[None]["n"] == 3 and plain[None]["roc_auc"] == 1.0 and plain["a"]["accuracy"] == 1.0
    weighted = {r["g"]: r["roc_auc"] for r in metrics.weighted_metrics(df, score="score", by=["g"]).collect()}
    assert weighted == {"a": 1.0, None: 1.0}


def test_curves_of_one_class(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.2), ("b", 1, 0.4), ("b", 1, 0.7)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    points = [r for r in metrics.roc_points(df, by=["g"]).collect() if r["g"] == "b" and r["threshold"] < 1]
    assert {r["fpr"] for r in points} == {None} and {r["tpr"] for r in points} == {0.5, 1.0}
    only = df.where("g = 'b'")
    for curve in (metrics.roc_points, metrics.pr_points):
        with pytest.raises(ValueError, match="both classes"):
            curve(only)


def test_empty_profile(spark):
    empty = spark.createDataFrame([], "a string, b double")
    assert {(r["missing"], r["pct"]) for r in profile.profile_missing(empty, ["a", "b"]).collect()} == {(0, None)}


def test_gate_histogram_by_mask(spark):
    rows = [(0, 0.0)] * 3 + [(1, 0.5), (1, 0.6), (1, 0.6)]
    df = spark.createDataFrame(rows, "context_mask int, gate double")
    assert {(r["context_mask"], r["bin"], r["n"]) for r in profile.gate_hist(df).collect()} == {(0, 15, 3), (1, 0, 1), (1, 29, 2)}


@pytest.mark.parametrize("copies", ["different rows", "equal rows", "one row"])
def test_repeated_ids_are_split_by_rows(spark, copies):
    n = F.col("id")
    label = (n % 2).cast("int")
    ids = {"different rows": n % 10, "equal rows": n % 10, "one row": n % 2}[copies]
    rows = spark.range(200).select(F.concat(F.lit("d"), ids).alias("id"), label.alias("label"), F.lit("a text").alias("text"))
    if copies == "different rows":
        rows = rows.withColumn("x", F.monotonically_increasing_id())
    with pytest.raises(split.RepeatedId):
        split.fit_split(rows)

    def parts(done):
        assert done.columns == [*rows.columns, "split"] and done.count() == 200
        return {(r["split"], r["label"]): r["count"] for r in done.groupBy("split", "label").count().collect()}

    done = split.split_dataset(rows)
    # 15 % of 85 % of 200 rounds up to 31
    assert parts(done) == {("train", 0): 70, ("train", 1): 69, ("val", 0): 15, ("val", 1): 16, ("test", 0): 15, ("test", 1): 15}
    strict = split.split_labeled_data(rows, text_column="text", label_column="label")
    assert parts(strict) == {("train", y): 60 for y in (0, 1)} | {(p, y): 20 for p in ("validation", "test") for y in (0, 1)}
    content = lambda df: sorted(map(tuple, df.collect()))
    if copies != "different rows":  # dealt out otherwise, the same rows go to the same parts
        assert content(split.split_dataset(rows.repartition(7))) == content(done)


def test_many_categories(spark):
    df = spark.range(20_000).select(
        "id", F.concat(F.lit("p"), "id").alias("source"), F.when(F.col("id") > 0, F.col("id").cast("double")).alias("x")
    )
    model = context.fit_context(df, numeric_columns=["x"], categorical_columns=["source"])
    assert context.feature_count(model) == 20_001
    names = context.feature_names(model)
    row = context.context_sparse(df.where("id = 77"), model).first()["context_sparse"]
    assert row["size"] == 20_001 and [names[i] for i in row["indices"]] == ["numeric__x", "categorical__source_p77"]
    dense = context.context_vector(df.where("id = 77"), model).first()["context_features"]
    assert len(dense) == 20_001 and sum(dense[1:]) == 1 and dense[row["indices"][1]] == 1


def test_categories_are_numbered_by_range(spark):
    """200,000 publishers: no window holds more than its share of them, and every index is used once."""
    df = spark.range(200_000).select(
        "id", F.concat(F.lit("p"), "id").alias("source"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("lang")
    )
    before = set(staged())
    model = context.fit_context(df, categorical_columns=["source", "lang"])
    (ranges,) = [p for p in set(staged()) - before if "category-ranges" in p]
    sizes = [r["count"] for r in spark.read.parquet(ranges).groupBy("column", "_range").count().collect()]
    assert max(sizes) < 100_000
    for column, n in (("source", 200_000), ("lang", 133_334)):
        rows = model.categories.where(F.col("column") == column)
        assert rows.agg(F.min("index"), F.max("index"), F.count_distinct("index")).first() == (0, n - 1, n)
    plan = context.context_sparse(df, model)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "array_contains" not in plan
    one = context.context_sparse(df.where("id = 199999"), model).first()["context_sparse"]
    assert one["size"] == 333_334 and len(one["indices"]) == 2
    first = {r["value"]: r["index"] for r in model.categories.where("column = 'source'").where("index < 3").collect()}
    assert first == {"p0": 0, "p1": 1, "p10": 2}


def test_sparse_and_dense_context_score_alike(spark):
    """The gated model reads indices and values; its gradient agrees with that of dense rows."""
    rng = np.random.default_rng(1)
    shape = fusion.FusionShape(3, 50, 4, 2, 3)
    model = fusion.FittedFusion(shape, shape.init(7))
    rows = []
    for k in range(60):
        at = sorted(rng.choice(50, k % 4, replace=False).tolist())
        rows.append((f"i{k}", rng.normal(size=3).tolist(), (50, at, rng.normal(size=len(at)).astype("float32").tolist()), k % 2, k % 2))
    schema = f"id string, text_features array<double>, context_features {SPARSE}, context_mask int, label int"
    sparse = spark.createDataFrame(rows, schema).repartition(3)
    lists = [(i, x, [dict(zip(c[1], c[2])).get(j, 0.0) for j in range(c[0])], m, y) for i, x, c, m, y in rows]
    dense = spark.createDataFrame(lists, schema.replace(SPARSE, "array<float>"))
    scores = [{r["id"]: (r["gate"], r["score"], r["domain_score"]) for r in model.domain_scores(df).collect()} for df in (sparse, dense)]
    assert scores[0].keys() == scores[1].keys()
    for i, got in scores[0].items():
        assert got == pytest.approx(scores[1][i], abs=1e-9)
    assert "predict_batch_udf" not in model.score(sparse)._jdf.queryExecution().optimizedPlan().toString()

    text, mask, label = (np.array([r[k] for r in lists]) for k in (1, 3, 4))
    batch = SparseRows.of([r[2][1] for r in rows], [r[2][2] for r in rows], 50)
    one, two = (
        fusion.gradient(shape, model.params, text, c, mask, label, domain=mask, lam=0.5) for c in (batch, np.array([r[2] for r in lists]))
    )
    assert one[0] == pytest.approx(two[0]) and np.allclose(one[4], two[4])
    assert fusion.check_features(sparse, shape) == 60
    broken = sparse.withColumn("context_features", F.col("context_features").withField("indices", F.array(F.lit(50))))
    assert fusion.feature_contract(broken, 3, 50).first()["bad_context_dim"] == 60


def test_saved_models(spark, tmp_path):
    texts = [(f"d{i}", "good trial data" if i % 2 else "secret cure claim", i % 2, "ab"[i % 2], float(i)) for i in range(20)]
    df = spark.createDataFrame(texts, "id string, text string, label int, source string, x double")
    model = classify.build_baseline(max_features=10).fit(df)
    model.save(spark, f"{tmp_path}/baseline")
    again = classify.FittedBaseline.load(spark, f"{tmp_path}/baseline")
    scores = lambda m: {r["id"]: r["score"] for r in m.predict(df).collect()}
    assert scores(again) == scores(model) and again.tfidf == model.tfidf
    fitted = context.fit_context(df, numeric_columns=["x"], categorical_columns=["source"])
    fitted.save(spark, f"{tmp_path}/context")
    loaded = context.ContextModel.load(spark, f"{tmp_path}/context")
    vectors = lambda m: {r["id"]: r["context_features"] for r in context.context_vector(df, m).collect()}
    assert vectors(loaded) == vectors(fitted)


def test_baseline_metrics_round_trip(spark, tmp_path):
    row = spark.createDataFrame([(0.5, 0.25, None)], "accuracy double, recall double, roc_auc double")
    experiments.write_baseline_metrics(row, f"{tmp_path}/base.csv")
    base = experiments.read_baseline_metrics(spark, f"{tmp_path}/base.csv")
    ours = spark.createDataFrame([("accuracy", 0.75), ("roc_auc", 0.5)], "metric string, value double")
    got = {r["metric"]: (r["model"], r["baseline"]) for r in experiments.compare_with_baseline(ours, base).collect()}
    assert got == {"accuracy": (0.75, 0.5), "roc_auc": (0.5, None)}


def test_headers_of_many_files(spark, tmp_path):
    (tmp_path / "a b+c.csv").write_text('id,"x, y"\n1,2\n')
    (tmp_path / "two.csv").write_text('id,z\n3,"4\n5"\n')
    paths = [str(tmp_path / n) for n in ("a b+c.csv", "two.csv")]
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    rows = {r["id"]: r for r in read_delimited(spark, paths).collect()}
    assert rows["1"]["x, y"] == "2" and rows["3"]["z"] == "4\n5" and before is not None


def test_staged_tables_can_be_released(spark):
    mark = len(session.staged())
    kept = session.stage(spark.range(5), "kept")
    session.stage(spark.range(6), "gone")
    session.release(spark, session.staged()[mark + 1 :])
    assert len(session.staged()) == mark + 1 and kept.count() == 5
    session.release(spark, session.staged()[mark:])
    assert len(session.staged()) == mark


def test_inspect_reads_a_table_four_times(spark):
    plan = profile.inspect_dataframe(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("doc_id").cast("string").alias("id"), "text", F.lit(1).alias("label"), "source",
        *[F.lit(True).alias(c) for c in ("has_source", "has_engagement", "has_network")],
    ))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4


def test_validation_part_must_hold_rows(spark):
    rows = spark.createDataFrame([("a", [0.5], [1.0], 1, 0)], "id string, text_features array<double>, context_features array<double>, context_mask int, label int")
    with pytest.raises(ValueError, match="contract"):
        fusion.train_fusion(rows, rows.where("false"), fusion.FusionShape(1, 1, 2))


def test_joined_vocabulary_gives_the_same_weights(spark):
    df = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, "")], "id int, text string")
    model = tfidf.fit_tfidf(df, "text")
    near = lambda f: {(r["id"], r["term"]): round(r["weight"], 9) for r in f.collect()}
    vocabulary, n = tfidf.fit_vocabulary(df, "text")
    joined = tfidf.weigh_terms(tfidf.count_terms(df, "id", "text"), "id", vocabulary, n)
    assert near(joined) == near(tfidf.transform_tfidf(df, "id", "text", model))


def test_reports_are_ordered(spark):
    df = spark.createDataFrame([("b", 1), ("a", None), ("a", 0), ("b", 0), ("b", 1)], "dataset string, label int")
    labels = [(r["dataset"], r["label"]) for r in profile.class_distribution(df).collect()]
    assert labels == [("a", 0), ("a", None), ("b", 0), ("b", 1)]
    assert [r["label"] for r in profile.profile_labels(df).collect()] == [0, 1, None]
    assert [r["column"] for r in profile.profile_missing(df, ["label", "dataset"]).collect()] == ["dataset", "label"]
