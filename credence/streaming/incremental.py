"""Row-local steps over files that keep arriving.

The batch loaders read finished files, and so does this: each run picks up what is
new and stops. Only steps without a global aggregate are used, so the same
functions serve batch and stream, and nothing keeps state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credence.operators.context import context_availability
from credence.operators.preprocess import add_text_stats, handle_missing
from credence.operators.tfidf import extract_text_statistics
from credence.schema import COUNT_COLUMNS, STANDARD_SCHEMA
from credence.sources.standard import standardize


def read_new_files(spark: SparkSession, path: str, schema=STANDARD_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def prepare_rows(df: DataFrame, context_columns=(*COUNT_COLUMNS, "source")) -> DataFrame:
    """Standardise, clean, filter, and add text statistics and the context mask."""
    rows = add_text_stats(handle_missing(standardize(df)))
    return context_availability(extract_text_statistics(rows, "text"), context_columns)


def process_available(rows: DataFrame, out_path: str, checkpoint_path: str) -> None:
    """Write everything that is new as Parquet, then stop (exactly once per file)."""
    (
        rows.writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
