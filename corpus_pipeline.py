"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, as a written table, and returns the columns of
``documents``; the last returns the pieces of the packed sequences. As a stage starts, its
predecessor's result is written, so the tables that the predecessor staged for itself are
deleted then. A driver runs one such pipeline at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from credence.llm.common import table
from credence.session import release, stage, staged

#: Rows of an Arrow batch, at most. Executor and worker each hold a batch of whole texts, and a worker some ten arrays of its
#: shingles or tokens; what a worker has held once it keeps through all later stages.
BATCH_ROWS = 2_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_LEFT: list[str] = []  # what the stage before has staged


def _stage_of_pipeline(step: Callable) -> Callable:
    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _LEFT)
        if not 0 < int(spark.conf.get(ARROW_ROWS)) <= BATCH_ROWS:  # stays set: the caller runs what is returned
            spark.conf.set(ARROW_ROWS, BATCH_ROWS)
        before = set(staged())
        out = step(spark, docs, sf_dir)
        _LEFT[:] = [path for path in staged() if path not in before]
        return out

    return run_step


@_stage_of_pipeline
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the models are fitted on what the stage is given."""
    return toxicity.ordinary(docs, table(spark, sf_dir, "labels"))


@_stage_of_pipeline
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of three lines or more that stand earlier in the corpus are cut."""
    cut = line_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


@_stage_of_pipeline
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents one stays."""
    return jaccard.one_each(docs)


@_stage_of_pipeline
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


@_stage_of_pipeline
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Token ids, and the models' scores, have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        release(spark, written)
        written = staged()[-1:]
    release(spark, _LEFT)
    return docs
