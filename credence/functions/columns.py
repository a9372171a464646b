"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later steps see as plain values.

    The optimiser merges projections and moves filters below them by copying the
    defining expression, so an expensive one would run once per use (per array
    element, inside a lambda). It does not copy through a generator.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def known(df: DataFrame, column: str) -> Column:
    """True where a value is there: not null, and not NaN in a floating-point column."""
    there = F.col(column).isNotNull()
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        there = there & ~F.isnan(column)
    return there


def number(column: str) -> Column:
    """The column as a double, NaN as null."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def join_by(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; keys appear once."""
    keys = list(keys)
    other = right.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    same = [left[k].eqNullSafe(other[f"_key_{k}"]) for k in keys]
    return left.join(other, same, how).drop(*[f"_key_{k}" for k in keys])
