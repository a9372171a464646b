"""Text baselines: TF-IDF plus L2 logistic regression, plain or class-weighted.

The objective is ``0.5 * |w|^2 + C * sum(weight_i * loss_i)`` with a penalised
intercept, which is a feature of ones. MLlib's optimiser works on features divided by
their deviations, where this objective is badly scaled (hundreds of passes over the rows);
``logistic.minimise`` takes a few. The fitted model is MLlib's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from credence.operators.logistic import minimise
from credence.operators.tfidf import MAX_FEATURES, TfidfModel, fit_tfidf, staged_entries, with_margin, with_margins
from credence.schema import require_columns

# ---- fixed values -----------------------------------------------------------
DEFAULT_C = 1.0
DEFAULT_SEED = 42
MAX_ITERATIONS = 2000
WEIGHTINGS = (None, "balanced")
# -----------------------------------------------------------------------------


def class_weights(df: DataFrame, label="label") -> DataFrame:
    """Inverse-frequency weight ``n / (k * n_c)`` per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.withColumn("_all", totals).select(
        label, "n", (F.col("_all.n") / (F.col("_all.k") * F.col("n"))).alias("weight")
    )


@dataclass(frozen=True)
class TextBaseline:
    """Settings of a baseline; ``fit`` takes the training frame only."""

    max_features: int = MAX_FEATURES
    c: float = DEFAULT_C
    class_weight: str | None = None
    random_state: int = DEFAULT_SEED

    def __post_init__(self):
        wrong = [
            f"{name}={value!r}"
            for name, value, fine in (
                ("max_features", self.max_features, self.max_features > 0),
                ("c", self.c, self.c > 0),
                ("class_weight", self.class_weight, self.class_weight in WEIGHTINGS),
            )
            if not fine
        ]
        if wrong:
            raise ValueError(f"unusable setting: {', '.join(wrong)}")

    def fit(
        self,
        train: DataFrame,
        *,
        id_column="id",
        text_column="text",
        label_column="label",
        tfidf: TfidfModel | None = None,
    ) -> "FittedBaseline":
        """``tfidf`` reuses a vocabulary already fitted on the same rows."""
        columns = dict(id_column=id_column, text_column=text_column, label_column=label_column)
        return fit_each([self], train, tfidf=tfidf, **columns)[0]


def fit_each(
    baselines: list[TextBaseline],
    train: DataFrame,
    *,
    id_column="id",
    text_column="text",
    label_column="label",
    tfidf: TfidfModel | None = None,
) -> "list[FittedBaseline]":
    """Baselines of one vocabulary, the first one's unless given, and of one table of training vectors: the texts are cut
    into terms once however many are fitted."""
    require_columns(train, [id_column, text_column, label_column])
    weights = {r[0]: r["weight"] for r in class_weights(train, label_column).collect()}
    if len(weights) != 2:
        raise ValueError(f"two classes are needed, got {sorted(weights)}")
    negative, positive = sorted(weights)
    tfidf = tfidf or fit_tfidf(train, text_column, max_features=baselines[0].max_features)
    target = F.when(F.col(label_column) == F.lit(positive), 1.0).otherwise(-1.0)
    # the optimiser passes over the vectors many times: compute them once
    entries = staged_entries(train.select(text_column, target.alias("target")), text_column, tfidf, "training-vectors")
    fitted = []
    for baseline in baselines:
        weight = F.lit(1.0)
        if baseline.class_weight == "balanced":
            weight = F.when(F.col("target") > 0, weights[positive]).otherwise(weights[negative])
        rows = entries.withColumn("weight", weight.cast("double"))
        found, _ = minimise(rows, len(tfidf.terms) + 1, tfidf.n_documents, baseline.c, MAX_ITERATIONS)
        fitted.append(FittedBaseline(tfidf, _mllib_model(train.sparkSession, found), (negative, positive), text_column))
    return fitted


def _mllib_model(spark: SparkSession, coefficients) -> LogisticRegressionModel:
    sc = spark.sparkContext
    java = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel
    return LogisticRegressionModel(java(LogisticRegressionModel._randomUID(), _py2java(sc, DenseVector(coefficients)), 0.0))


@dataclass(frozen=True)
class FittedBaseline:
    tfidf: TfidfModel
    model: LogisticRegressionModel
    classes: tuple
    text_column: str = "text"

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` (probability above one half) and ``score``; row-local and native.

        The model itself is not sent to executors: it carries the training summary and, with that, the session,
        which cannot be serialised while anything in it is observed.
        """
        rows = with_margin(df, self.text_column, self.tfidf, self.model.coefficients.toArray(), "_margin")
        return rows.withColumns(self._called("_margin")).drop("_margin")

    def _called(self, margin: str) -> dict[str, Column]:
        negative, positive = self.classes
        return {
            "prediction": F.when(F.col(margin) > 0, F.lit(positive)).otherwise(F.lit(negative)),
            "score": 1 - 1 / (1 + F.exp(margin)),
        }

    def save(self, spark: SparkSession, path: str) -> None:
        """Vocabulary, coefficients and classes in three folders."""
        self.tfidf.save(spark, f"{path}/tfidf")
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame(
            [(list(self.classes), self.text_column)], "classes array<int>, text_column string"
        ).write.mode("overwrite").parquet(f"{path}/classes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedBaseline":
        kept = spark.read.parquet(f"{path}/classes").first()
        return FittedBaseline(
            TfidfModel.load(spark, f"{path}/tfidf"), LogisticRegressionModel.load(f"{path}/model"),
            tuple(kept["classes"]), kept["text_column"],
        )


def predict_each(models: dict[str, FittedBaseline], df: DataFrame, name="model") -> DataFrame:
    """``predict`` of every model, told apart by ``name``. They share a vocabulary and a text column, so the texts are cut into
    terms once."""
    first = next(iter(models.values()))
    if any(m.tfidf is not first.tfidf or m.text_column != first.text_column for m in models.values()):
        raise ValueError("the models differ in vocabulary or text column")
    margins = {f"_margin_{k}": m.model.coefficients.toArray() for k, m in enumerate(models.values())}
    rows = with_margins(df, first.text_column, first.tfidf, margins)
    called = [
        F.struct(F.lit(label).alias(name), *[c.alias(to) for to, c in m._called(margin).items()])
        for (label, m), margin in zip(models.items(), margins, strict=True)
    ]
    return rows.select(*df.columns, F.inline(F.array(*called)))


def build_baseline(*, max_features=MAX_FEATURES, c=DEFAULT_C, class_weight=None, random_state=DEFAULT_SEED) -> TextBaseline:
    return TextBaseline(max_features, c, class_weight, random_state)


def build_balanced_baseline(*, max_features=MAX_FEATURES, c=DEFAULT_C, random_state=DEFAULT_SEED) -> TextBaseline:
    return TextBaseline(max_features, c, "balanced", random_state)
