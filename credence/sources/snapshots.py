"""Dated CSV snapshots of news (and claims), one file per kind and class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from credence.functions.text import url_domain
from credence.schema import ORDER
from credence.sources import paths
from credence.sources.delimited import read_delimited
from credence.sources.standard import standardize

# ---- fixed values -----------------------------------------------------------
KINDS = ("News", "Claim")
CLASSES = {"Fake": 1, "Real": 0}
FILE_SUFFIX = "COVID-19.csv"
FIELDS = ("news_url", "title", "content", "abstract", "tweet_id")
# -----------------------------------------------------------------------------


def snapshot_rows(rows: DataFrame, *, dataset="coaid") -> DataFrame:
    """Standard table from rows with ``kind``, ``lab``, ``snapshot``, ``row_id``,
    the raw fields and the order column."""
    return standardize(
        rows.withColumns(
            {
                "id": F.concat_ws("_", F.lit(dataset), "snapshot", "kind", "lab", "row_id"),
                "dataset": F.lit(dataset),
                "subset": F.lower("kind"),
                "text": F.coalesce("content", "abstract"),
                "label": (F.col("lab") == "Fake").cast("int"),
                "label_raw": F.concat("kind", "lab"),
                "source": url_domain("news_url"),
                "n_tweets": F.size(F.split("tweet_id", "\t")).cast("double"),
            }
        )
    )


def load_coaid(
    root, include_claims=False, *, spark: SparkSession | None = None
) -> DataFrame:
    spark = spark or SparkSession.active()
    kinds = KINDS if include_claims else KINDS[:1]
    names = [f"{kind}{lab}{FILE_SUFFIX}" for kind in kinds for lab in CLASSES]
    files = [f for name in names for f in paths.find_files(spark, str(root), name)]
    if not files:
        raise FileNotFoundError(f"no snapshot CSV files under {root}")

    raw = read_delimited(spark, files, numbered="id")
    for name in FIELDS:
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))

    file = F.element_at(F.split("_file", "/"), -1)
    pattern = rf"^({'|'.join(KINDS)})({'|'.join(CLASSES)})"
    rank = F.array_position(F.array(*map(F.lit, names)), file)
    return snapshot_rows(
        raw.withColumns(
            {
                "kind": F.regexp_extract(file, pattern, 1),
                "lab": F.regexp_extract(file, pattern, 2),
                "snapshot": F.element_at(F.split("_file", "/"), -2),
                "row_id": F.coalesce("id", F.lit("nan")),
                ORDER: F.struct(
                    rank.cast("int").alias("part"),
                    # folder by folder, as sorted paths compare
                    F.replace("_file", F.lit("/"), F.lit("\u0001")).alias("file"),
                    F.col("_row").alias("row"),
                ),
            }
        )
    )
