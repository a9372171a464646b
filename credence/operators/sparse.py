"""Sparse rows through array code: a batch of (size, indices, values) that multiplies like a matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

SPARSE = "struct<size:int,indices:array<int>,values:array<float>>"


@dataclass(frozen=True)
class SparseRows:
    """Rows of equal width; entry k stands in row ``rows[k]`` and column ``columns[k]``."""

    shape: tuple[int, int]
    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(indices, values, width: int) -> "SparseRows":
        """From one array of indices and one of values a row."""
        rows = np.repeat(np.arange(len(indices)), np.fromiter(map(len, indices), np.int64, len(indices)))
        flat = lambda x, kind: np.concatenate([*x, []]).astype(kind)
        return SparseRows((len(indices), width), rows, flat(indices, np.int64), flat(values, np.float64))

    @staticmethod
    def of_arrow(column: pa.Array, width: int) -> "SparseRows":
        indices, values = column.field("indices"), column.field("values")
        rows = np.repeat(np.arange(len(column)), np.diff(indices.offsets.to_numpy()))
        return SparseRows(
            (len(column), width), rows, indices.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(np.float64)
        )

    def __len__(self) -> int:
        return self.shape[0]

    def __mul__(self, by_row: np.ndarray) -> "SparseRows":
        return SparseRows(self.shape, self.rows, self.columns, self.values * np.ravel(by_row)[self.rows])

    def __matmul__(self, weights: np.ndarray) -> np.ndarray:
        """Only the rows of ``weights`` that the entries name are read."""
        out = np.zeros((self.shape[0], weights.shape[1]))
        np.add.at(out, self.rows, self.values[:, None] * weights[self.columns])
        return out

    @property
    def T(self) -> "SparseRows":  # noqa: N802
        return SparseRows(self.shape[::-1], self.columns, self.rows, self.values)

    def part(self, start: int, stop: int) -> "SparseRows":
        low, high = np.searchsorted(self.rows, (start, stop))
        return SparseRows(
            (min(stop, len(self)) - start, self.shape[1]), self.rows[low:high] - start, self.columns[low:high], self.values[low:high]
        )


def is_sparse(df, column: str) -> bool:
    return df.schema[column].dataType.typeName() == "struct"


def width(df, column: str) -> Column:
    """Number of features of a dense or sparse row."""
    return F.col(f"{column}.size") if is_sparse(df, column) else F.size(column)


def is_malformed(column: str) -> Column:
    """A sparse row whose values do not match its indices, or whose indices leave its width."""
    indices = F.col(f"{column}.indices")
    return (F.size(indices) != F.size(f"{column}.values")) | F.exists(
        indices, lambda i: i.isNull() | (i < 0) | (i >= F.col(f"{column}.size"))
    )
