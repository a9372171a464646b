"""Snapshots of the standard and processed tables."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from credence.schema import PROCESSED_SCHEMA
from credence.sources import paths
from credence.sources.delimited import headers, parse, read_records

# Null is written as \N and an empty string as a quoted empty cell, so that a CSV
# round trip keeps the two apart. Line breaks inside a cell are quoted.
CSV_OPTIONS = dict(
    header=True, quote='"', escape='"', multiLine=True, nullValue="\\N",
    ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
)


def save_processed(
    df: DataFrame, name: str, out_dir="data/processed", fmt="parquet", partition_by=()
) -> str:
    """Write ``<name>_processed.<fmt>``; the path is returned.

    ``partition_by=("dataset", "split")`` lets later reads prune whole folders.
    """
    path = paths.join(out_dir, f"{name}_processed.{fmt}")
    write_table(df, path, partition_by)
    return path


def write_table(df: DataFrame, path: str, partition_by=()) -> None:
    fmt = _format_of(path)
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS, emptyValue='""')
    writer.format(fmt).save(path)


def load_processed(
    name: str, in_dir="data/processed", fmt="parquet", *, spark: SparkSession | None = None
) -> DataFrame:
    path = paths.join(in_dir, f"{name}_processed.{fmt}")
    return load_standardized_data(path, spark=spark)


def load_standardized_data(
    path, schema=PROCESSED_SCHEMA, *, spark: SparkSession | None = None
) -> DataFrame:
    """Read by suffix; CSV needs the declared schema (nothing is inferred)."""
    spark = spark or SparkSession.active()
    path = str(path)
    if not paths.exists(spark, path):
        raise FileNotFoundError(f"nothing to load at {path}")
    if _format_of(path) == "csv":
        return _read_csv(spark, path, schema)
    return spark.read.parquet(path)


def _read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """A CSV table, each file of it in as many tasks as it has blocks; folders named ``column=value`` give columns."""
    records = read_records(spark, path)
    found = headers(records)
    names = {h for _, h in found}
    if len(names) != 1:
        raise ValueError(f"the files of {path} have {len(names)} different headers" if names else f"no header in {path}")
    (header,) = names
    types = {f.name: f.dataType.simpleString() for f in schema.fields}
    declared = ", ".join(f"`{h}` {types.get(h, 'string')}" for h in header)
    rows = parse(records, declared, nullValue=CSV_OPTIONS["nullValue"], emptyValue="")
    folders = [c for c in rows.columns if not c.startswith("_")]
    return rows.select("_cells.*", *[F.col(c).cast(types.get(c, "string")).alias(c) for c in folders])


def _format_of(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in (".csv", ".parquet"):
        raise ValueError(f"unsupported file type {suffix!r}: use .csv or .parquet")
    return suffix[1:]


def save_config(spark: SparkSession, config: dict, path: str) -> None:
    """A run's settings as a one-row JSON table."""
    row = spark.createDataFrame([(json.dumps(config),)], "config string")
    row.write.mode("overwrite").text(path)


def load_config(spark: SparkSession, path: str) -> dict:
    """The settings that ``save_config`` wrote."""
    rows = spark.read.text(path).collect()  # one row
    if len(rows) != 1:
        raise ValueError(f"{path} holds {len(rows)} rows, not the one of a saved configuration")
    return json.loads(rows[0]["value"])
