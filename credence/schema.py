"""The standard table every source produces and every operator consumes."""

from __future__ import annotations

from pyspark.sql import types as T

# Name of the order column. pandas has an implicit row order and "keep first"
# depends on it; Spark has none, so each source emits a sortable, unique value.
ORDER = "_ord"

STANDARD_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("subset", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("label_raw", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_tweets", T.DoubleType()),
        T.StructField("n_replies", T.DoubleType()),
        T.StructField("n_retweets", T.DoubleType()),
        T.StructField("has_source", T.BooleanType()),
        T.StructField("has_engagement", T.BooleanType()),
        T.StructField("has_network", T.BooleanType()),
        T.StructField("split", T.StringType()),
    ]
)
STANDARD_COLUMNS = STANDARD_SCHEMA.names
COUNT_COLUMNS = ["n_tweets", "n_replies", "n_retweets"]
FLAG_COLUMNS = ["has_source", "has_engagement", "has_network"]

PROCESSED_SCHEMA = T.StructType(
    STANDARD_SCHEMA.fields
    + [
        T.StructField("text_len", T.IntegerType()),
        T.StructField("word_count", T.IntegerType()),
    ]
)


def require_columns(df, columns, what="column"):
    """Raise ``KeyError`` naming what is missing and what is there (no job)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(
            f"{what} not found: {missing}; available: {', '.join(df.columns)}"
        )
