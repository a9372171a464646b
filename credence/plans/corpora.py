"""How the given tables stand in for the corpora.

``documents`` with ``labels`` is the labelled corpus and ``events`` its engagement
(views, clicks and purchases as the three counts; null without any event).
``pages`` is an HTML corpus with URLs, ``benchmark`` a claim corpus without context;
their labels are id parity and carry no meaning. ``embeddings`` are text features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from credence.functions.text import url_domain
from credence.operators.context import context_availability, context_sparse, fit_context
from credence.schema import COUNT_COLUMNS, ORDER
from credence.sources.standard import standardize

INPUT_PARTITIONS = "credence.input.partitions"
EVENT_COUNTS = {"n_tweets": "view", "n_replies": "click", "n_retweets": "purchase"}
CONTEXT_NUMERIC = COUNT_COLUMNS
CONTEXT_CATEGORICAL = ["source", "subset"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose text is about to be processed row by row. A caller whose files are
    too few to split (one row group in all) may deal the rows out by setting
    ``INPUT_PARTITIONS`` in the session; without it nothing moves."""
    rows = table(spark, sf_dir, name)
    parts = spark.conf.get(INPUT_PARTITIONS, None)
    return rows.repartition(int(parts)) if parts else rows


def engagement(spark, sf_dir) -> DataFrame:
    """Counts per user; combined before the shuffle, so a hot user is no problem."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        *[
            F.count_if(F.col("event_type") == kind).cast("double").alias(name)
            for name, kind in EVENT_COUNTS.items()
        ]
    )


def documents_raw(spark, sf_dir) -> DataFrame:
    docs = texts(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    counts = engagement(spark, sf_dir).withColumnRenamed("user_id", "doc_id")
    return docs.join(labels, "doc_id", "left").join(counts, "doc_id", "left").select(
        F.concat(F.lit("doc_"), "doc_id").alias("id"),
        F.lit("documents").alias("dataset"),
        F.col("lang").alias("subset"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
        (1 - F.col("quality")).alias("label"),
        F.col("quality").cast("string").alias("label_raw"),
        "source",
        *EVENT_COUNTS,
        F.col("doc_id").alias(ORDER),
    )


def documents(spark, sf_dir) -> DataFrame:
    return standardize(documents_raw(spark, sf_dir))


def pages(spark, sf_dir) -> DataFrame:
    parity = F.pmod("page_id", F.lit(2))
    return standardize(
        texts(spark, sf_dir, "pages").select(
            F.concat(F.lit("page_"), "page_id").alias("id"),
            F.lit("pages").alias("dataset"),
            F.lit("web").alias("subset"),
            F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
            F.col("html").alias("text"),
            parity.alias("label"),
            parity.cast("string").alias("label_raw"),
            url_domain("url").alias("source"),
            F.col("page_id").alias(ORDER),
        )
    )


def benchmark(spark, sf_dir) -> DataFrame:
    parity = F.pmod("item_id", F.lit(2))
    return standardize(
        table(spark, sf_dir, "benchmark").select(
            F.concat(F.lit("claim_"), "item_id").alias("id"),
            F.lit("benchmark").alias("dataset"),
            F.lit("claim").alias("subset"),
            F.col("text").alias("title"),
            "text",
            parity.alias("label"),
            parity.cast("string").alias("label_raw"),
            F.col("item_id").alias(ORDER),
        )
    )


def all_corpora(spark, sf_dir) -> DataFrame:
    return (
        documents(spark, sf_dir)
        .unionByName(pages(spark, sf_dir))
        .unionByName(benchmark(spark, sf_dir))
    )


def hash_score(key: Column | str) -> Column:
    """A score from the id, for checking metrics without a model (ties on purpose)."""
    key = F.col(key) if isinstance(key, str) else key
    first = F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("double")
    return F.round(first / 65535.0, 2)


def hash_predictions(spark, sf_dir) -> DataFrame:
    """Labelled documents with the id score, its 0.5 prediction and the mask."""
    score = hash_score("id")
    return (
        documents(spark, sf_dir)
        .where("label is not null")
        .select(
            "id", "label", score.alias("score"),
            F.col("has_engagement").cast("int").alias("context_mask"),
        )
        .withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    )


def context_model(spark, sf_dir):
    return fit_context(
        documents(spark, sf_dir),
        numeric_columns=CONTEXT_NUMERIC, categorical_columns=CONTEXT_CATEGORICAL,
    )


def fusion_inputs(spark, sf_dir) -> DataFrame:
    """Embeddings joined by id to sparsely encoded context and the engagement mask. English
    documents are the source domain."""
    model = context_model(spark, sf_dir)
    context = context_availability(
        context_sparse(documents(spark, sf_dir), model, "context_features"), COUNT_COLUMNS, "context_mask"
    ).select(
        F.col(ORDER).alias("vec_id"), "id", "context_features", "context_mask",
        (F.col("subset") != "en").cast("int").alias("domain_label"),
    )
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("text_features"),
        (F.col("label") >= 5).cast("int").alias("label"),
    )
    return vectors.join(context, "vec_id").drop("vec_id")
