import hashlib
import math

import pytest
from pyspark.sql import functions as F

from credence.operators import split as S


def _frame(spark, sizes):
    rows, n = [], 0
    for label, k in sizes.items():
        for _ in range(k):
            rows.append((f"r{n}", f"text {n}", label))
            n += 1
    return spark.createDataFrame(rows, "id string, text string, label int").repartition(5)


def _rank(i, seed=42):
    return hashlib.md5(f"{i}:{seed}".encode()).hexdigest()


def brute_force(rows, sizes, stratify):
    """Quota and order rule, row by row."""
    left, out = dict(rows), {}
    for name, share in sizes:
        counts = {}
        for label in left.values():
            counts[label] = counts.get(label, 0) + 1
        counts = dict(sorted(counts.items()))
        n_out = math.ceil(share * len(left))
        by_class = stratify(counts)
        quotas = S.held_out_quotas(counts, n_out) if by_class else {None: n_out}
        for label, q in quotas.items():
            pool = sorted((i for i, y in left.items() if label in (None, y)), key=_rank)
            for i in pool[:q]:
                out[i] = name
        left = {i: y for i, y in left.items() if i not in out}
    return out | {i: "train" for i in left}


@pytest.mark.parametrize("sizes", [
    {0: 4, 1: 3}, {0: 500, 1: 61}, {0: 20, 1: 2}, {0: 40}, {0: 5000, 1: 4999, 2: 17}, {0: 9, 1: 3},
])
def test_70_15_15(spark, sizes):
    df = _frame(spark, sizes)
    rows = {r["id"]: r["label"] for r in df.collect()}
    plan = S.fit_split(df)
    got = {r["id"]: r["split"] for r in plan.apply(df).collect()}
    rule = lambda c: len(c) > 1 and min(c.values()) >= 3
    assert got == brute_force(rows, [("test", 0.15), ("val", 0.15 / 0.85)], rule)
    n = len(rows)
    n_test = math.ceil(0.15 * n)
    assert plan.sizes["test"] == n_test == list(got.values()).count("test")
    assert plan.sizes["train"] == list(got.values()).count("train")


def test_fallback_in_the_second_cut(spark):
    """The smallest class can be stratified once, but not twice."""
    sizes = {0: 30, 1: 3}
    df = _frame(spark, sizes)
    rows = {r["id"]: r["label"] for r in df.collect()}
    got = {r["id"]: r["split"] for r in S.split_dataset(df).collect()}
    rule = lambda c: len(c) > 1 and min(c.values()) >= 3
    assert got == brute_force(rows, [("test", 0.15), ("val", 0.15 / 0.85)], rule)


def test_60_20_20(spark):
    df = _frame(spark, {0: 77, 1: 23})
    out = S.split_labeled_data(df, text_column="text", label_column="label")
    parts = {(r["split"], r["label"]): r["count"] for r in out.groupBy("split", "label").count().collect()}
    assert parts == {
        ("test", 0): 15, ("test", 1): 5, ("validation", 0): 15, ("validation", 1): 5,
        ("train", 0): 47, ("train", 1): 13,
    }


def test_quotas():
    assert S.class_quotas({0: 5, 1: 5}, 5) == {0: 3, 1: 2}  # tie goes to the smaller label
    assert sum(S.held_out_quotas({0: 101, 1: 37, 2: 9}, 30).values()) == 30


def test_contract(spark):
    ok = _frame(spark, {0: 10, 1: 10})
    call = lambda df, **kw: S.split_labeled_data(df, **{"text_column": "text", "label_column": "label", **kw})
    with pytest.raises(ValueError):
        call(ok, text_column="label")
    with pytest.raises(KeyError):
        call(ok, text_column="nope")
    with pytest.raises(ValueError):
        call(ok, test_size=0.7, validation_size=0.3)
    with pytest.raises(ValueError):
        call(ok.withColumn("text", F.when(F.col("id") != "r0", F.col("text"))))
    with pytest.raises(ValueError):
        call(ok.withColumn("text", F.when(F.col("id") == "r0", " ").otherwise(F.col("text"))))
    with pytest.raises(ValueError):
        call(_frame(spark, {0: 10}))
    with pytest.raises(ValueError):
        call(_frame(spark, {0: 20, 1: 1}))
    with pytest.raises(ValueError):
        call(_frame(spark, {0: 40, 1: 2}))


def test_seed_changes_the_draw(spark):
    df = _frame(spark, {0: 60, 1: 40})
    one = {r["id"] for r in S.split_dataset(df, seed=1).where("split = 'test'").collect()}
    two = {r["id"] for r in S.split_dataset(df, seed=2).where("split = 'test'").collect()}
    assert len(one) == len(two) and one != two


def test_applying_a_plan_needs_no_shuffle(spark):
    df = _frame(spark, {0: 60, 1: 40})
    plan = S.fit_split(df).apply(spark.range(10).select(F.col("id").cast("string"), F.lit(1).alias("label")))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
