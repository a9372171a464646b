"""Classification metrics and curves as grouped aggregations.

Every function takes a predictions frame and optional group columns, so all
models, conditions or datasets are measured in one job. Rows are first collapsed
to counts per (group, truth, prediction, score); nothing is ordered globally in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from credence.functions.columns import join_by
from credence.operators.prefix import running_sums
from credence.schema import require_columns

METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "average_precision"]


def _n(df: DataFrame) -> Column:
    """Row weight: a collapsed frame carries ``n``, a raw one counts 1."""
    return F.col("_n") if "_n" in df.columns else F.lit(1).cast("long")


def collapse(df: DataFrame, columns) -> DataFrame:
    """Distinct value combinations with their row count in ``_n``."""
    return df.groupBy(*columns).agg(F.sum(_n(df)).alias("_n"))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _score_table(df, truth, score, positive_label, by, pred=None, ranges=None) -> DataFrame:
    """One row per (group, score): class counts and their running sums from the
    highest score down."""
    positive = F.col(truth) == F.lit(positive_label)
    n = _n(df)
    sums = {"_pos": F.when(positive, n), "_neg": F.when(~positive, n)}
    if pred is not None:
        called = F.col(pred) == F.lit(positive_label)
        sums["_tp"] = F.when(positive & called, n)
        sums["_fp"] = F.when(~positive & called, n)
    table = df.groupBy(*by, score).agg(
        *[F.sum(F.coalesce(v, F.lit(0))).alias(k) for k, v in sums.items()]
    )
    return running_sums(
        table, score, {"_cum_pos": "_pos", "_cum_neg": "_neg"}, by, descending=True, ranges=ranges
    )


def _auc() -> Column:
    pos, neg = F.sum("_pos").cast("double"), F.sum("_neg").cast("double")
    area = F.sum((F.col("_cum_pos") - F.col("_pos") / 2) * F.col("_neg").cast("double"))
    return F.when((pos > 0) & (neg > 0), area / (pos * neg))


def _average_precision() -> Column:
    pos, neg = F.sum("_pos").cast("double"), F.sum("_neg").cast("double")
    steps = F.sum(F.col("_pos") * (F.col("_cum_pos") / (F.col("_cum_pos") + F.col("_cum_neg"))))
    return F.when((pos > 0) & (neg > 0), steps / pos)


def roc_auc(df, truth="label", score="score", positive_label=1, by=(), ranges=None) -> DataFrame:
    """Area under the ROC curve, ties counted half; null with one class only."""
    table = _score_table(df, truth, score, positive_label, list(by), ranges=ranges)
    return table.groupBy(*by).agg(_auc().alias("roc_auc"))


def average_precision(df, truth="label", score="score", positive_label=1, by=(), ranges=None) -> DataFrame:
    """Step-wise average precision (no interpolation); null with one class only."""
    table = _score_table(df, truth, score, positive_label, list(by), ranges=ranges)
    return table.groupBy(*by).agg(_average_precision().alias("average_precision"))


def _with_totals(table: DataFrame, by) -> DataFrame:
    totals = table.groupBy(*by).agg(
        F.struct(F.sum("_pos").alias("pos"), F.sum("_neg").alias("neg")).alias("_all")
    )
    if by:
        return join_by(table, totals, by)
    return table.withColumn("_all", totals.scalar())


def _share(part: str, whole: str) -> Column:
    """Null where a group has no row of the class."""
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def _both_classes(table: DataFrame, by, positive_label) -> DataFrame:
    """A curve over all rows needs both classes; a group that lacks one gets null rates."""
    if not by:
        found = table.agg(F.sum("_pos").alias("pos"), F.sum("_neg").alias("neg")).first()
        if not found["pos"] or not found["neg"]:
            raise ValueError(
                f"a curve needs both classes: {found['pos'] or 0} rows are {positive_label!r}, {found['neg'] or 0} are not"
            )
    return _with_totals(table, by)


def roc_points(df, truth="label", score="score", positive_label=1, by=(), ranges=None) -> DataFrame:
    """``(threshold, fpr, tpr)`` at every distinct score, plus the origin, whose
    threshold is infinity."""
    by = list(by)
    table = _both_classes(_score_table(df, truth, score, positive_label, by, ranges=ranges), by, positive_label)
    points = table.select(
        *by,
        F.col(score).cast("double").alias("threshold"),
        _share("_cum_neg", "_all.neg").alias("fpr"),
        _share("_cum_pos", "_all.pos").alias("tpr"),
    )
    zero = F.lit(0.0)
    if by:
        origin = df.select(*by).distinct()
    else:
        origin = df.sparkSession.range(1).select()
    start = origin.select(
        *by, F.lit(float("inf")).alias("threshold"), zero.alias("fpr"), zero.alias("tpr")
    )
    return points.unionByName(start)


def pr_points(df, truth="label", score="score", positive_label=1, by=(), ranges=None) -> DataFrame:
    """``(threshold, precision, recall)`` at every distinct score, plus the end
    point (1, 0), which has no threshold."""
    by = list(by)
    table = _both_classes(_score_table(df, truth, score, positive_label, by, ranges=ranges), by, positive_label)
    points = table.select(
        *by,
        F.col(score).cast("double").alias("threshold"),
        (F.col("_cum_pos") / (F.col("_cum_pos") + F.col("_cum_neg"))).alias("precision"),
        _share("_cum_pos", "_all.pos").alias("recall"),
    )
    origin = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    end = origin.select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def binary_metrics(
    df, truth="label", pred="prediction", score="score", positive_label=1, by=(), ranges=None
) -> DataFrame:
    """Positive-class metrics, one row per group, from a single score table."""
    by = list(by)
    table = _score_table(df, truth, score, positive_label, by, pred, ranges)
    counts = table.groupBy(*by).agg(
        F.sum(F.col("_pos") + F.col("_neg")).alias("n"),
        F.sum("_pos").alias("positive_count"),
        F.sum("_tp").alias("tp"),
        F.sum("_fp").alias("fp"),
        _auc().alias("roc_auc"),
        _average_precision().alias("average_precision"),
    )
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("positive_count") - tp
    tn = F.col("n") - F.col("positive_count") - fp
    return counts.select(
        *by,
        "n",
        "positive_count",
        _ratio(tp + tn, F.col("n")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, F.col("positive_count")).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "roc_auc",
        "average_precision",
    )


def confusion(df, labels, truth="label", pred="prediction", by=()) -> DataFrame:
    """Counts for every cell of the label grid, negative label first; a cell
    without rows is 0."""
    cells = [
        F.struct(
            F.lit(t).alias(truth),
            F.lit(p).alias(pred),
            F.sum(
                F.when((F.col(truth) == F.lit(t)) & (F.col(pred) == F.lit(p)), _n(df)).otherwise(0)
            ).alias("n"),
        )
        for t in labels
        for p in labels
    ]
    return df.groupBy(*by).agg(F.array(*cells).alias("_cells")).select(*by, F.inline("_cells"))


def class_counts(df, truth="label", pred="prediction", by=()) -> DataFrame:
    """Support, predicted count and hits per class (classes of truth and prediction)."""
    by = list(by)
    pairs = collapse(df, [*by, truth, pred])
    hit = F.when(F.col(truth) == F.col(pred), F.col("_n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col(truth).alias("class"), F.col("_n").alias("support"), zero.alias("predicted"), hit.alias("hits")),
        F.struct(F.col(pred).alias("class"), zero.alias("support"), F.col("_n").alias("predicted"), zero.alias("hits")),
    )
    return pairs.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
        F.sum("hits").alias("hits"),
    )


def _per_class(counts: DataFrame) -> DataFrame:
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return counts.withColumns(
        {
            "precision": _ratio(hits, predicted),
            "recall": _ratio(hits, support),
            "f1": _ratio(2 * hits, support + predicted),
        }
    )


def weighted_metrics(
    df, truth="label", pred="prediction", score=None, positive_label=1, by=(), ranges=None
) -> DataFrame:
    """Support-weighted accuracy, precision, recall and F1, one row per group; with
    ``score`` also ROC AUC (null unless both classes occur)."""
    by = list(by)
    if score is not None:
        df = collapse(df, [*by, truth, pred, score])
    per_class = _per_class(class_counts(df, truth, pred, by))
    support = F.sum("support")
    out = per_class.groupBy(*by).agg(
        support.alias("n"),
        (F.sum("hits") / support).alias("accuracy"),
        *[
            (F.sum(F.col(m) * F.col("support")) / support).alias(m)
            for m in ("precision", "recall", "f1")
        ],
    )
    if score is None:
        return out
    auc = roc_auc(df, truth, score, positive_label, by, ranges)
    return join_by(out, auc, by, "left") if by else out.withColumn("roc_auc", auc.scalar())


def class_report(df, truth="label", pred="prediction", by=()) -> DataFrame:
    """Per-class rows, then accuracy, macro and weighted averages, in long form."""
    by = list(by)
    per_class = _per_class(class_counts(df, truth, pred, by))
    names = ("precision", "recall", "f1")
    rows = per_class.select(*by, F.col("class").cast("string").alias("class"), *names, "support")
    support = F.sum("support")
    null = F.lit(None).cast("double")
    summary = per_class.groupBy(*by).agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("class"), null.alias("precision"), null.alias("recall"),
                (F.sum("hits") / support).alias("f1"), support.alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("class"),
                *[F.avg(m).alias(m) for m in names], support.alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("class"),
                *[(F.sum(F.col(m) * F.col("support")) / support).alias(m) for m in names],
                support.alias("support"),
            ),
        ).alias("_rows")
    )
    return rows.unionByName(summary.select(*by, F.inline("_rows")))


def evaluate_binary_classifier(
    df, *, classes, positive_label, name, truth="label", pred="prediction", score="score"
) -> DataFrame:
    """``binary_metrics`` after checking the contract, as one named row."""
    require_columns(df, [truth, pred, score])
    classes = list(classes)
    others = [c for c in classes if c != positive_label]
    if len(others) != 1 or len(classes) == 1:
        raise ValueError(f"one class besides {positive_label!r} is needed, {classes} leaves {len(others)}")
    seen = df.agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(~F.col(truth).isin(classes), F.lit(True))).alias("unknown"),
    ).first()
    if seen["n"] == 0:
        raise ValueError("nothing to evaluate")
    if seen["unknown"]:
        raise ValueError(f"{seen['unknown']} rows have labels outside {classes}")
    metrics = binary_metrics(df, truth, pred, score, positive_label)
    return metrics.select(F.lit(name).alias("name"), "*")
