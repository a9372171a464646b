"""Fact-checked claims in three TSV files; text only, no context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from credence.schema import ORDER
from credence.sources import paths
from credence.sources.delimited import read_delimited
from credence.sources.standard import standardize

# ---- fixed values -----------------------------------------------------------
FILES = ("train", "dev", "test")
KEEP_LABELS = ("true", "false")
LABEL_MAP = {"false": 1, "true": 0}
# -----------------------------------------------------------------------------


def claim_rows(raw: DataFrame, keep_labels=KEEP_LABELS, *, dataset="pubhealth") -> DataFrame:
    """Standard table from ``claim_id, claim, main_text, label`` and the order column.

    Kept labels outside the map (for example ``mixture``) get a null label.
    """
    mapped = F.create_map(*[F.lit(x) for kv in LABEL_MAP.items() for x in kv])
    return standardize(
        raw.where(F.col("label").isin(*keep_labels)).withColumns(
            {
                "id": F.concat(F.lit(f"{dataset}_"), "claim_id"),
                "dataset": F.lit(dataset),
                "subset": F.lit("claim"),
                "title": F.col("claim"),
                "text": F.col("main_text"),
                "label_raw": F.col("label"),
                "label": mapped[F.col("label")],
            }
        )
    )


def load_pubhealth(
    root, keep_labels=KEEP_LABELS, *, spark: SparkSession | None = None
) -> DataFrame:
    spark = spark or SparkSession.active()
    files = [paths.join(root, f"{name}.tsv") for name in FILES]
    files = [f for f in files if paths.exists(spark, f)]
    if not files:
        raise FileNotFoundError(f"no claim TSV files under {root}")
    raw = read_delimited(spark, files, sep="\t")
    stem = F.regexp_extract("_file", r"([^/]+)\.tsv$", 1)
    rank = F.array_position(F.array(*map(F.lit, FILES)), stem)
    order = F.struct(
        rank.cast("int").alias("part"), F.lit("").alias("file"), F.col("_row").alias("row")
    )
    raw = raw.withColumns({ORDER: order, "claim_id": F.coalesce("claim_id", F.lit("nan"))})
    return claim_rows(raw, keep_labels)
