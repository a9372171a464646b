import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.operators import context as C

ROWS = [
    (1, 1.0, 5.0, None, "a", "x"), (2, None, 5.0, None, "b", None), (3, 4.0, 5.0, None, "", None),
    (4, 10.0, 5.0, None, None, None), (5, None, None, None, "b", " "), (6, 0.0, 5.0, None, "a", "x"),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(
        ROWS, "id int, n1 double, flat double, nothing double, c1 string, c2 string"
    ).repartition(4)


def test_mask(spark, frame):
    rows = {r["id"]: r for r in C.context_availability(frame, ["n1", "nothing", "c1", "c2"]).collect()}
    assert [rows[i]["context_available"] for i in range(1, 7)] == [1, 1, 1, 1, 1, 1]
    fractions = [rows[i]["context_availability_fraction"] for i in range(1, 7)]
    assert fractions == [0.75, 0.25, 0.25, 0.25, 0.25, 0.75]  # 0 is present, blank is not
    none = C.context_availability(frame, []).first()
    assert (none["context_available"], none["context_availability_fraction"]) == (0, 0.0)
    only_blank = C.context_availability(frame.where("id = 5"), ["c2"]).first()
    assert only_blank["context_available"] == 0
    types = dict(C.context_availability(frame, ["n1"]).dtypes)
    assert (types["context_available"], types["context_availability_fraction"]) == ("tinyint", "float")


def test_numeric(frame):
    model = C.fit_context(frame, numeric_columns=["n1", "flat", "nothing"])
    assert [c for c, *_ in model.numeric] == ["n1", "flat"]  # the all-null column is dropped
    filled = np.array([1.0, 2.5, 4.0, 10.0, 2.5, 0.0])
    expected = (filled - filled.mean()) / filled.std()
    rows = {(r["id"], r["feature"]): r["value"] for r in C.context_numeric(frame, "id", model).collect()}
    assert [rows[(i, "numeric__n1")] for i in range(1, 7)] == pytest.approx(list(expected))
    assert all(rows[(i, "numeric__flat")] == 0 for i in range(1, 7))


@pytest.mark.parametrize("limit", [0, C.BROADCAST_BYTES])
def test_onehot(spark, frame, limit, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_BYTES", limit)
    model = C.fit_context(frame, categorical_columns=["c1", "c2"])
    assert model.fill == {"c1": "a", "c2": "x"}  # a and b tie: the smaller value
    rows = {(r["id"], r["feature"]) for r in C.context_onehot(frame, "id", model).collect()}
    assert (4, "categorical__c1_a") in rows and (3, "categorical__c1_") in rows
    assert (2, "categorical__c2_x") in rows and (5, "categorical__c2_ ") in rows
    assert len(rows) == 12
    fresh = spark.createDataFrame([(9, "new", None)], "id int, c1 string, c2 string")
    assert [r["feature"] for r in C.context_onehot(fresh, "id", model).collect()] == ["categorical__c2_x"]


def test_vector_matches_the_long_form(frame):
    columns = dict(numeric_columns=["n1", "flat", "nothing"], categorical_columns=["c1", "c2"])
    model, long = C.fit_context_features(frame, "id", **columns)
    names = C.feature_names(model)
    assert names == [
        "numeric__n1", "numeric__flat", "categorical__c1_", "categorical__c1_a", "categorical__c1_b",
        "categorical__c2_ ", "categorical__c2_x",
    ]
    values = {(r["id"], r["feature"]): r["value"] for r in long.collect()}
    for r in C.context_vector(frame, model).collect():
        assert r["context_features"] == pytest.approx([values.get((r["id"], n), 0.0) for n in names])


def test_contract(frame):
    with pytest.raises(ValueError):
        C.fit_context(frame, numeric_columns=["n1"], categorical_columns=["n1"])
    with pytest.raises(KeyError):
        C.fit_context(frame, numeric_columns=["zz"])
    model = C.fit_context(frame)
    assert C.transform_context(frame, "id", model).count() == 0
    assert C.context_vector(frame, model).first()["context_features"] == []


def test_all_null_category_is_dropped(spark):
    df = spark.createDataFrame([(1, None, "a")], "id int, c string, d string")
    model = C.fit_context(df, categorical_columns=["c", "d"])
    assert model.fill == {"d": "a"}
    assert [r["feature"] for r in C.transform_context(df, "id", model).collect()] == ["categorical__d_a"]
