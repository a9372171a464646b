"""L2 logistic regression over sparse rows: ``0.5 * |w|^2 + scale * sum(weight * loss)``.

Each pass is one job over all rows that returns one loss and one gradient; the driver holds vectors of the features'
number. The steps are those of L-BFGS, shaped by the curvature of evenly spread rows (at most ``PER_FEATURE`` a feature), so the
passes hardly grow with the rows: without that, every direction of the features has to be learnt from passes. Those
rows decide how fast the minimum is reached, not where it is: loss and gradient are always of all rows. Above
``WIDEST`` features their matrix would be too large for a driver, and the steps are plain.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from credence.operators.fusion import GRADIENT_SCHEMA, _gradient_row, sum_gradients

# ---- fixed values -----------------------------------------------------------
#: Norm of the gradient at the end. The objective curves by one at least in all directions, so this bounds the
#: distance from the minimiser, and with it the error of the margin of any row of length one.
GRADIENT = 1e-7
HISTORY = 10
SLICE = 1_024  # rows that a task works on at a time
PER_FEATURE = 4
WIDEST = 6_000
RENEWED = (0, 2, 5)  # steps before which the curvature is taken anew
ROUNDING = 1e-12
# -----------------------------------------------------------------------------


def _slices(batches):
    """(target, weight, row of each entry, indices, values) of up to ``SLICE`` rows; targets are 1 and -1."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            b = batch.slice(at, SLICE)
            indices = b.column(b.schema.names.index("indices"))
            row = np.repeat(np.arange(len(indices)), np.diff(indices.offsets.to_numpy()))
            values = b.column(b.schema.names.index("values")).flatten().to_numpy(zero_copy_only=False)
            target, weight = (b.column(b.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("target", "weight"))
            yield target, weight, row, indices.flatten().to_numpy(zero_copy_only=False), values


def _margin(n: int, row, indices, values, w) -> np.ndarray:
    return np.bincount(row, values * w[indices], n)


def _chance(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-z)) without overflow."""
    small = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, small) / (1.0 + small)


def loss_and_gradient(rows: DataFrame, partitions: int, w: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Summed weights, weighted losses and their gradient over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        from pyspark import TaskContext

        w = shared.value
        totals, grad = np.zeros(4), np.zeros(len(w))
        for target, weight, row, indices, values in _slices(batches):
            m = target * _margin(len(target), row, indices, values, w)
            totals += [len(target), weight.sum(), (weight * np.logaddexp(0.0, -m)).sum(), 0.0]
            pull = -weight * target * _chance(-m)
            grad += np.bincount(indices, values * pull[row], len(w))
        if totals[0]:
            yield _gradient_row(TaskContext.get().partitionId(), totals, grad)

    totals, grad = sum_gradients(rows.mapInArrow(run, GRADIENT_SCHEMA), partitions)
    shared.destroy()
    return float(totals[1]), float(totals[2]), grad


def spread_rows(rows: DataFrame, every: int) -> list[tuple[np.ndarray, ...]]:
    """(target, weight, lengths, indices, values) of each ``every``-th row of a partition, a packed row a slice."""

    def run(batches):
        passed = 0
        for target, weight, row, indices, values in _slices(batches):
            chosen = (passed + np.arange(len(target))) % every == 0
            passed += len(target)
            if chosen.any():
                own = chosen[row]
                lengths = np.bincount(row, minlength=len(target))[chosen]
                parts = (target[chosen], weight[chosen], lengths.astype(np.int64), indices[own].astype(np.int32), values[own])
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], list("twlxv"))

    kinds = (np.float64, np.float64, np.int64, np.int32, np.float64)
    packed = rows.mapInArrow(run, "t binary, w binary, l binary, x binary, v binary").toLocalIterator()
    return [tuple(np.frombuffer(p, kind) for p, kind in zip(r, kinds, strict=True)) for r in packed]


def curvature(sample: list, scale: float, w: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """``g -> M^-1 g`` for ``M = 1 + scale * sum(weight * p * (1 - p) * x x')`` over the sample."""
    width, n = len(w), sum(len(t) for t, *_ in sample)

    def dense():
        for target, weight, lengths, indices, values in sample:
            row = np.repeat(np.arange(len(target)), lengths)
            p = _chance(_margin(len(target), row, indices, values, w))
            x = np.zeros((len(target), width))
            x[row, indices] = values * np.sqrt(scale * weight * p * (1 - p))[row]
            yield x

    if n <= width:
        x = np.concatenate(list(dense()))
        inner = np.linalg.inv(np.eye(n) + x @ x.T)
        return lambda g: g - x.T @ (inner @ (x @ g))
    matrix = np.eye(width)
    for x in dense():
        x = x.astype(np.float32)
        matrix += x.T @ x
    inverse = np.linalg.inv(matrix)
    return lambda g: (inverse @ g + g @ inverse) / 2


def minimise(rows: DataFrame, width: int, n: int, c: float, most: int) -> tuple[np.ndarray, int]:
    """Weights at the minimum, and the passes it took, for staged ``rows`` (indices, values, target, weight).

    ``scale`` is ``c`` where the weights sum up to ``n``, and else keeps the mean loss.
    """
    partitions = rows.rdd.getNumPartitions()
    w = np.zeros(width)
    total, loss, grad = loss_and_gradient(rows, partitions, w)
    scale, passes = c * n / total, 1
    every = -(-n // (PER_FEATURE * width))
    sample = spread_rows(rows, every) if width <= WIDEST else []
    f, g = scale * loss, scale * grad
    pairs: deque = deque(maxlen=HISTORY)
    shaped = lambda v: v / max(1.0, scale)
    for step in range(most):
        if np.linalg.norm(g) <= GRADIENT:
            break
        if sample and step in RENEWED:
            shaped = curvature(sample, scale * every, w)
        d = -_two_loops(g, pairs, shaped)
        slope = g @ d
        if slope >= 0:  # by rounding alone
            break
        length = 1.0
        while True:
            at = w + length * d
            _, loss, grad = loss_and_gradient(rows, partitions, at)
            passes += 1
            new_f, new_g = 0.5 * at @ at + scale * loss, at + scale * grad
            if new_f <= f + 1e-4 * length * slope + ROUNDING * abs(f) or length < 1e-9:
                break
            length /= 2
        if length < 1e-9:
            break
        if (new_g - g) @ (at - w) > 0:
            pairs.append((at - w, new_g - g))
        w, f, g = at, new_f, new_g
    return w, passes


def _two_loops(g: np.ndarray, pairs, shaped) -> np.ndarray:
    """Inverse curvature times gradient: the pairs of steps and differences correct what ``shaped`` knows."""
    q, kept = g.copy(), []
    for s, y in reversed(pairs):
        a = (s @ q) / (s @ y)
        q -= a * y
        kept.append(a)
    q = shaped(q)
    for (s, y), a in zip(pairs, reversed(kept), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return q
