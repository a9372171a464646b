"""Labelled training rows: which count, and bounded samples of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT = 2


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept back from learning; a null id is learnt from by nobody but not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def training_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y): one label per id that may be learnt from; where an id has several, the larger."""
    return (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    )


def sample(rows: DataFrame, size: int) -> DataFrame:
    """At most ``size`` rows, the first in the order of a hash of the id."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50):
    """Weights of a logistic curve on standardised columns, and what standardises them."""
    centre = x.mean(0) if len(x) else np.zeros(x.shape[1])
    scale = np.maximum(x.std(0), 1e-9) if len(x) else np.ones(x.shape[1])
    z = np.c_[(x - centre) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, scale


def fit_logistic_rows(points: DataFrame, columns: list[str], weights: dict[int, float], ridge: float = 1e-2, rounds: int = 50):
    """``fit_logistic`` of the rows (y, columns) of a staged table with a weight a class. Each round is one aggregation;
    only sums come to the driver."""
    k = len(columns)
    first = points.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    centre = np.array([v or 0.0 for v in first[:k]])
    scale = np.array([1.0 if v is None else max(v, 1e-9) for v in first[k:]])
    z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(columns, centre, scale, strict=True)] + [F.lit(1.0)]
    kept = points.select(*[v.alias(f"z{j}") for j, v in enumerate(z)], F.col("y").cast("double").alias("y"))
    at = [F.col(f"z{j}") for j in range(k + 1)]
    weight = F.when(F.col("y") == 1, float(weights[1])).otherwise(float(weights[0]))
    pairs = [(i, j) for i in range(k + 1) for j in range(i + 1)]
    w = np.zeros(k + 1)
    for _ in range(rounds):
        power = sum(v * float(b) for v, b in zip(at, w, strict=True))
        p = 1 / (1 + F.exp(-F.least(F.greatest(power, F.lit(-30.0)), F.lit(30.0))))
        parts = kept.select(*at, (weight * p * (1 - p)).alias("h"), (weight * (F.col("y") - p)).alias("g"))
        sums = parts.agg(*[F.sum(F.col("h") * at[i] * at[j]) for i, j in pairs], *[F.sum(F.col("g") * v) for v in at]).first()
        hessian = ridge * np.eye(k + 1)
        for (i, j), v in zip(pairs, sums, strict=False):
            hessian[i, j] += v or 0.0
            hessian[j, i] = hessian[i, j]
        step = np.linalg.solve(hessian, np.array([v or 0.0 for v in sums[len(pairs):]]) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, scale


def logistic(x: np.ndarray, fitted) -> np.ndarray:
    w, centre, scale = fitted
    return 1 / (1 + np.exp(-np.clip(np.c_[(x - centre) / scale, np.ones(len(x))] @ w, -30, 30)))
