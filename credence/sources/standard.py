"""Bring any source frame into the standard table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from credence.functions.text import is_blank
from credence.schema import COUNT_COLUMNS, ORDER, STANDARD_SCHEMA


def standardize(df: DataFrame) -> DataFrame:
    """Add missing columns as null, coerce counts, derive flags, fix the order.

    A count that is null stays null ("unavailable"); it is never filled with 0.
    The order column is carried along when the source has one.
    """
    present = set(df.columns)
    types = {f.name: f.dataType for f in STANDARD_SCHEMA.fields}

    def base(name):
        if name not in present:
            return F.lit(None).cast(types[name])
        if name in COUNT_COLUMNS:
            return F.nanvl(F.col(name).try_cast("double"), F.lit(None).cast("double"))
        return F.col(name).cast(types[name])

    derived = {
        "has_source": F.coalesce(~is_blank(base("source")), F.lit(False)),
        "has_engagement": F.coalesce(*[base(c) for c in COUNT_COLUMNS]).isNotNull(),
        "has_network": F.coalesce(base("has_network"), F.lit(False)),
    }
    columns = [derived.get(n, base(n)).alias(n) for n in STANDARD_SCHEMA.names]
    if ORDER in present:
        columns.append(F.col(ORDER))
    return df.select(*columns)
