"""Cleaning, de-duplication and the processed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window, functions as F

from credence.functions.columns import computed_once
from credence.functions.text import DEFAULT_MIN_WORDS, clean_text, word_count
from credence.operators.split import fit_split
from credence.schema import ORDER
from credence.session import materialize, stage, stage_bucketed


def handle_missing(df: DataFrame, min_words=DEFAULT_MIN_WORDS) -> DataFrame:
    """Clean title and text, use the title where the body is empty, then drop
    unlabelled and short rows. Row-local; the label filter reaches the scan, and
    each value is cleaned once although the word filter needs it too."""
    cleaned = computed_once(
        df.where(F.col("label").isNotNull()),
        {"_title": clean_text("title"), "_text": clean_text("text")},
    )
    body = F.when(F.col("_text") == "", F.col("_title")).otherwise(F.col("_text"))
    return (
        cleaned.withColumns(
            {"title": F.col("_title"), "text": body, "label": F.col("label").cast("int")}
        )
        .drop("_title", "_text")
        .where(word_count("text") >= min_words)
    )


def add_text_stats(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "text_len": F.char_length("text").cast("int"),
            "word_count": word_count("text").cast("int"),
        }
    )


def keep_first(df: DataFrame, key: str, order=ORDER) -> DataFrame:
    """First row per key. Spark prunes with a group limit on both sides of the
    shuffle, so a key holding a third of all rows sends one row per map task."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_rank", first).where("_rank = 1").drop("_rank")


def duplicate_keys(df: DataFrame, id_column="id", text_column="text", order=ORDER, extra=()):
    """The narrow columns that de-duplication needs; a text is a SHA-256 digest of
    its lower-case form."""
    return df.select(
        order,
        *extra,
        F.col(id_column).alias("_id_key"),
        F.unhex(F.sha2(F.lower(text_column), 256)).alias("_text_key"),
    )


def first_of_keys(keys: DataFrame, order=ORDER) -> DataFrame:
    """First row by id, then, among those, first by text."""
    kept = keep_first(keep_first(keys, "_id_key", order), "_text_key", order)
    return kept.drop("_id_key", "_text_key")


def first_occurrences(df: DataFrame, id_column="id", text_column="text", order=ORDER, extra=()):
    """Order values of the rows that de-duplication keeps. Only keys are shuffled,
    never bodies."""
    return first_of_keys(duplicate_keys(df, id_column, text_column, order, extra), order)


def kept_rows(table: DataFrame, kept: DataFrame, order=ORDER) -> DataFrame:
    """The rows of a table bucketed by ``order`` that are in ``kept``. Only the order values are shuffled, to the
    buckets; each task hashes those of its bucket, so the wide rows neither move nor get sorted."""
    return table.join(kept.select(order).hint("shuffle_hash"), order, "left_semi")


def remove_duplicates(df: DataFrame, id_column="id", text_column="text", order=ORDER) -> DataFrame:
    """Drop repeated ids, then repeated texts (case-insensitive), keeping the first.

    The rows are staged once in buckets of the unique order value. Repeats are sought among narrow
    columns, and the kept order values go to the buckets, so the wide rows
    move only as they are written and no copy group can make a hot partition.
    """
    table = stage_bucketed(df, "to-deduplicate", order)
    kept = first_occurrences(table, id_column, text_column, order)
    return kept_rows(table, kept, order)


def pipeline_counts(df: DataFrame, min_words=DEFAULT_MIN_WORDS) -> DataFrame:
    """Rows in, after the filter, and after de-duplication, as one row. The corpus is read once: rows are counted as
    they pass, while the narrow keys are staged."""
    raw, filtered = Observation(), Observation()
    rows = df.observe(raw, F.count(F.lit(1)).alias("n"))
    kept = handle_missing(rows, min_words).observe(filtered, F.count(F.lit(1)).alias("n"))
    keys = stage(duplicate_keys(kept), "duplicate-keys")
    # both passed in a job without a shuffle, where a task that is run again counts once
    return first_of_keys(keys).agg(F.count("*").alias("rows_deduplicated")).select(
        F.lit(raw.get["n"]).cast("long").alias("rows_raw"), F.lit(filtered.get["n"]).cast("long").alias("rows_filtered"),
        "rows_deduplicated",
    )


def clean_and_deduplicate(df: DataFrame, min_words=DEFAULT_MIN_WORDS):
    """Cleaned rows without duplicates, and the kept ``(order, id, label)`` rows.

    Cleaning costs far more than a write, so the cleaned rows are staged once, in buckets of the
    order value and with their text digest. De-duplication then reads only narrow columns, and the wide
    rows are read once more where they lie.
    """
    cleaned = add_text_stats(handle_missing(df, min_words))
    digest = F.unhex(F.sha2(F.lower("text"), 256))
    staged = stage_bucketed(cleaned.withColumn("_text_key", digest), "cleaned", ORDER)
    keys = staged.select(ORDER, "id", "label", F.col("id").alias("_id_key"), "_text_key")
    kept = materialize(first_of_keys(keys))
    return kept_rows(staged.drop("_text_key"), kept), kept


def preprocess_dataset(df: DataFrame, min_words=DEFAULT_MIN_WORDS, seed=42) -> DataFrame:
    """Filter, de-duplicate, add text statistics and the 70/15/15 split, which is
    fitted on the kept ids and applied row by row."""
    rows, kept = clean_and_deduplicate(df, min_words)
    return fit_split(kept, seed=seed).apply(rows.drop("split"))
