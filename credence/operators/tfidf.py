"""TF-IDF over 1- to n-grams: fitted vocabulary, weights, and vectors.

Definition: ``tf`` occurrences in the document, ``df`` documents with the gram,
``idf = ln((1 + n) / (1 + df)) + 1``, ``w = (1 + ln tf) * idf`` (or ``tf * idf``),
divided by the document's L2 norm. ``n`` counts every document, empty ones too.
MLlib's ``IDF`` lacks the ``+ 1``, so the weight is written out here.

Counting happens inside each row (sort the grams, measure run lengths), so the
long gram stream is never shuffled. Fitting counts each part of the corpus where it is read and
shuffles only the counts of terms that can be among the most frequent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from credence.functions.columns import computed_once
from credence.functions.text import text_statistics, tokens
from credence.schema import require_columns
from credence.session import stage

# ---- fixed values -----------------------------------------------------------
MAX_FEATURES = 5000
NGRAM_RANGE = (1, 2)
# -----------------------------------------------------------------------------
#: Distinct terms that a task counts together.
PART_TERMS = 1_000_000
#: Terms that are sent to all tasks, at most; more are joined by a shuffle.
BROADCAST_TERMS = 2_000_000


def with_grams(df: DataFrame, text_column: str, ngram_range=NGRAM_RANGE) -> DataFrame:
    """Adds ``_grams``: all n-grams; adjacent kept tokens are joined by one space."""
    low, high = ngram_range
    df = computed_once(df, {"_tokens": tokens(text_column)})
    parts = [_joined("_tokens", n) for n in range(low, high + 1)]
    grams = F.concat(*parts) if len(parts) > 1 else parts[0]
    return computed_once(df, {"_grams": grams}).drop("_tokens")


def _joined(token_array: str, n: int) -> Column:
    if n == 1:
        return F.col(token_array)
    size = F.size(token_array)
    starts = F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        starts, lambda i: F.concat_ws(" ", *[F.get(token_array, i + k) for k in range(n)])
    )


def with_term_counts(df: DataFrame, text_column: str, ngram_range=NGRAM_RANGE) -> DataFrame:
    """Adds ``_terms``, an ``array<struct<term, tf>>``: run lengths of the sorted grams."""
    df = with_grams(df, text_column, ngram_range)
    df = computed_once(df, {"_sorted": F.sort_array("_grams")}).drop("_grams")
    n = F.size("_sorted")
    is_start = lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1))
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), is_start)).otherwise(
        F.array().cast("array<int>")
    )
    df = computed_once(df, {"_starts": starts})
    run = lambda start, j: F.struct(
        F.get("_sorted", start).alias("term"),
        (F.coalesce(F.get("_starts", j + 1), n) - start).cast("long").alias("tf"),
    )
    df = computed_once(df, {"_terms": F.transform("_starts", run)})
    return df.drop("_sorted", "_starts")


def count_terms(df: DataFrame, id_column: str, text_column: str, ngram_range=NGRAM_RANGE) -> DataFrame:
    """Long ``(id, term, tf)`` table, built without a shuffle."""
    require_columns(df, [id_column, text_column], "text column")
    counted = with_term_counts(df.select(id_column, text_column), text_column, ngram_range)
    return counted.select(id_column, F.inline("_terms"))


@dataclass(frozen=True)
class TfidfModel:
    """Fitted vocabulary in column order; its size is bounded by ``max_features``."""

    terms: list
    idf: list = field(repr=False)
    document_frequency: list = field(repr=False)
    term_frequency: list = field(repr=False)
    n_documents: int
    ngram_range: tuple = NGRAM_RANGE
    sublinear_tf: bool = True

    def vocabulary(self, spark) -> DataFrame:
        rows = pd.DataFrame(
            {
                "term": self.terms,
                "idx": np.arange(len(self.terms), dtype="int32"),
                "tf": np.array(self.term_frequency, dtype="int64"),
                "df": np.array(self.document_frequency, dtype="int64"),
                "idf": np.array(self.idf, dtype="float64"),
            }
        )
        return spark.createDataFrame(rows, "term string, idx int, tf long, df long, idf double")

    def save(self, spark, path: str) -> None:
        """The vocabulary and, beside it, the settings, as Parquet."""
        self.vocabulary(spark).write.mode("overwrite").parquet(f"{path}/vocabulary")
        low, high = self.ngram_range
        spark.createDataFrame(
            [(self.n_documents, low, high, self.sublinear_tf)],
            "n_documents long, low int, high int, sublinear_tf boolean",
        ).write.mode("overwrite").parquet(f"{path}/settings")

    @staticmethod
    def load(spark, path: str) -> "TfidfModel":
        s = spark.read.parquet(f"{path}/settings").first()
        rows = spark.read.parquet(f"{path}/vocabulary").orderBy("idx").collect()
        column = lambda name: [r[name] for r in rows]
        return TfidfModel(
            column("term"), column("idf"), column("df"), column("tf"), s["n_documents"],
            (s["low"], s["high"]), s["sublinear_tf"],
        )


LOCAL = "part string, term string, tf long, df long, place int, documents long"


def _local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted terms of documents to counts of the whole part of the corpus that a task reads, most frequent first.

    Documents come as lists of terms, or term by term with a null term for each document, so that a batch does not grow
    with the length of the texts. A part is closed when it holds ``PART_TERMS`` terms; its first row carries the number
    of its documents.
    """
    held, fresh, waiting, documents, number = None, [], 0, 0, 0

    def summed() -> pa.Table:
        rows = pa.concat_tables([*fresh, *([] if held is None else [held])])
        return rows.group_by("term").aggregate([("tf", "sum"), ("df", "sum")]).rename_columns(["term", "tf", "df"])

    def close(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if not documents and not rows.num_rows:
            return
        if not rows.num_rows:  # documents without a term
            rows = pa.table({"term": pa.nulls(1, pa.string()), "tf": pa.array([0], pa.int64()), "df": pa.array([0], pa.int64())})
        rows = rows.sort_by([("tf", "descending")])
        n = rows.num_rows
        rows = rows.add_column(0, "part", pa.array([f"{TaskContext.get().partitionId()}-{number}"] * n))
        rows = rows.append_column("place", pa.array(np.arange(n, dtype=np.int32)))
        rows = rows.append_column("documents", pa.array(np.where(np.arange(n) == 0, documents, 0)))
        yield from rows.combine_chunks().to_batches(max_chunksize=100_000)

    for batch in batches:
        terms, found = batch.column(0), batch.num_rows
        if pa.types.is_list(terms.type):
            terms = terms.flatten()
        else:
            found = terms.field("term").null_count
            terms = terms.filter(terms.field("term").is_valid()) if found else terms
        ones = pa.array(np.ones(len(terms), np.int64))
        fresh.append(pa.table({"term": terms.field("term"), "tf": terms.field("tf"), "df": ones}))
        waiting += len(terms)
        documents += found
        if waiting >= PART_TERMS // 4:
            held, fresh, waiting = summed(), [], 0
            if held.num_rows >= PART_TERMS:
                yield from close(held)
                held, documents, number = None, 0, number + 1
            pa.default_memory_pool().release_unused()
    if fresh or held is not None:  # a document may have begun in the part before
        yield from close(summed())


def local_counts(df: DataFrame, text_column: str, ngram_range=NGRAM_RANGE) -> DataFrame:
    """(part, term, tf, df, place, documents): counts of every part of the corpus where it is read, no shuffle."""
    counted = with_term_counts(df.select(text_column), text_column, ngram_range)
    document = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf")))
    return counted.select(F.explode(F.concat(document, "_terms")).alias("_term")).mapInArrow(_local_counts, LOCAL)


def most_frequent(parts: DataFrame, k: int, least_df: float = 1) -> DataFrame:
    """The ``k`` terms with the highest total count (ties: term ascending) among those in ``least_df`` documents, exactly, as
    (term, tf, df), from staged ``local_counts``.

    The heads of the parts give partial totals; the k-th of them is a lower bound of the k-th total. A term that reaches
    it has at least an m-th of it in one of the m parts. Only terms that do are summed over all parts,
    so the long tail of rare terms is never shuffled.
    """
    total = lambda rows: rows.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    known = parts.where("term is not null")
    heads = total(known.where(F.col("place") < k)).where(F.col("df") >= F.lit(least_df)).orderBy(F.desc("tf")).limit(k)
    found = heads.agg(F.count("*").alias("n"), F.min("tf").alias("bound")).first()
    m = parts.where("place = 0").count()
    share = -(-found["bound"] // m) if found["n"] == k else 1
    if share > 1:
        able = stage(known.where(F.col("tf") >= share).select("term").distinct(), "terms-that-can-reach")
        few = able.count() <= BROADCAST_TERMS
        known = known.join(F.broadcast(able) if few else able, "term", "left_semi")
    return total(known).where(F.col("df") >= F.lit(least_df)).orderBy(F.desc("tf"), "term").limit(k)


def fit_vocabulary(
    df: DataFrame,
    text_column: str,
    *,
    max_features=MAX_FEATURES,
    ngram_range=NGRAM_RANGE,
    min_df=1,
) -> tuple[DataFrame, int]:
    """The kept ``(term, tf, df)`` rows and the number of documents, from one pass over the texts.

    Terms are kept by total count (ties: term ascending) among those in at least
    ``min_df`` documents (a float is a share of all documents).
    """
    require_columns(df, [text_column], "text column")
    parts = stage(local_counts(df, text_column, ngram_range), "local-term-counts")
    n_documents = parts.where("place = 0").agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]
    least = min_df * n_documents if isinstance(min_df, float) else min_df
    return most_frequent(parts, max_features, least), n_documents


def fit_tfidf(
    df: DataFrame,
    text_column: str,
    *,
    max_features=MAX_FEATURES,
    ngram_range=NGRAM_RANGE,
    min_df=1,
    sublinear_tf=True,
) -> TfidfModel:
    """Fit on the training frame only. The driver and every executor hold the
    ``max_features`` rows; where they should not, ``fit_vocabulary`` with
    ``weigh_terms`` gives the same weights from a joined table."""
    if max_features < 1:
        raise ValueError(f"max_features={max_features!r} keeps no term")
    kept, n = fit_vocabulary(
        df, text_column, max_features=max_features, ngram_range=ngram_range, min_df=min_df
    )
    # binary (UTF-8) order of the terms gives the column index
    rows = sorted(kept.collect(), key=lambda r: r["term"].encode())
    return TfidfModel(
        terms=[r["term"] for r in rows],
        idf=[math.log((1 + n) / (1 + r["df"])) + 1 for r in rows],
        document_frequency=[r["df"] for r in rows],
        term_frequency=[r["tf"] for r in rows],
        n_documents=n,
        ngram_range=tuple(ngram_range),
        sublinear_tf=sublinear_tf,
    )


def _array_literal(values, kind: str) -> Column:
    """One literal that the optimiser folds, not one expression per element.
    Grams hold word characters and spaces only, so a comma is free."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _weights(df: DataFrame, text_column: str, model: TfidfModel) -> DataFrame:
    """Adds ``_indices`` and weights ``_raw`` before normalising; row-local.

    ``CountVectorizerModel`` broadcasts the vocabulary as a hash map and counts
    only known grams, so unseen terms cost one lookup each.
    """
    require_columns(df, [text_column], "text column")
    if not model.terms:
        return df.withColumns(
            {"_indices": F.array().cast("array<int>"), "_raw": F.array().cast("array<double>")}
        )
    vectorizer = CountVectorizerModel.from_vocabulary(
        model.terms, inputCol="_grams", outputCol="_counts"
    )
    counted = vectorizer.transform(with_grams(df, text_column, model.ngram_range))
    counted = computed_once(counted, {"_sparse": F.unwrap_udt("_counts")}).withColumns(
        {"_indices": F.col("_sparse.indices"), "_tf": F.col("_sparse.values")}
    )
    idf = _array_literal(model.idf, "double")
    tf = lambda v: 1 + F.log(v) if model.sublinear_tf else v
    weight = F.transform("_tf", lambda v, i: tf(v) * F.get(idf, F.get("_indices", i)))
    weighted = computed_once(counted, {"_raw": weight})
    return weighted.drop("_grams", "_counts", "_sparse", "_tf")


def transform_tfidf(df: DataFrame, id_column: str, text_column: str, model: TfidfModel) -> DataFrame:
    """Long ``(id, idx, term, weight)`` rows; a document without known terms has none."""
    require_columns(df, [id_column], "id column")
    weighted = _weights(df.select(id_column, text_column), text_column, model)

    norm = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda acc, v: acc + v * v))
    weighted = computed_once(weighted, {"_norm": norm})
    unit = F.transform(
        "_raw", lambda w, i: F.struct(F.get("_indices", i).alias("idx"), (w / F.col("_norm")).alias("weight"))
    )
    long = computed_once(weighted, {"_unit": unit}).select(id_column, F.inline("_unit"))
    return long.select(
        id_column,
        "idx",
        F.get(_array_literal(model.terms, "string"), F.col("idx")).alias("term"),
        "weight",
    )


def weigh_terms(
    counts: DataFrame, id_column: str, vocabulary: DataFrame, n_documents: int, sublinear_tf=True
) -> DataFrame:
    """Long weights from ``(id, term, tf)`` and a vocabulary table ``(term, df)`` of any
    size: the vocabulary is joined, not collected. Up to ``BROADCAST_TERMS`` terms go to the
    counts, so only known terms are shuffled, once, by id; more are joined by a shuffle, where a term
    found in most documents is a hot join key, which AQE splits. ``counts`` is read once, ``vocabulary``
    twice (a staged table). A row without an id has no weight."""
    idf = F.log((1 + F.lit(n_documents)) / (1 + F.col("df"))) + 1
    tf = 1 + F.log("tf") if sublinear_tf else F.col("tf")
    known = vocabulary.select("term", "df")
    few = known.count() <= BROADCAST_TERMS
    raw = counts.where(F.col(id_column).isNotNull()).join(F.broadcast(known) if few else known, "term").select(
        id_column, "term", (tf * idf).alias("_raw")
    )
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(id_column)))
    return raw.select(id_column, "term", (F.col("_raw") / norm).alias("weight"))


@F.pandas_udf(VectorUDT())
def _as_vector(size: pd.Series, indices: pd.Series, values: pd.Series) -> pd.DataFrame:
    """Columns as the struct behind a sparse vector; nothing is computed here."""
    kind = np.zeros(len(size), dtype="int8")
    return pd.DataFrame({"type": kind, "size": size, "indices": indices, "values": values})


def _sparse_rows(
    df: DataFrame, text_column: str, model: TfidfModel, sign: Column | None = None
) -> tuple[DataFrame, dict[str, Column]]:
    """The frame with the columns ``_indices``, ``_raw`` and ``_norm``, and the parts of its L2-normalised vectors."""
    weighted = _weights(df, text_column, model)
    norm = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda acc, v: acc + v * v))
    weighted = computed_once(weighted, {"_norm": norm})
    size, indices = F.lit(len(model.terms)), F.col("_indices")
    values = F.transform("_raw", lambda w: w / F.col("_norm"))
    if sign is not None:
        indices = F.concat(indices, F.array(size))
        size, factor = size + 1, sign.cast("double")
        values = F.concat(F.transform(values, lambda w: w * factor), F.array(factor))
    return weighted, {"type": F.lit(0).cast("tinyint"), "size": size.cast("int"), "indices": indices, "values": values}


def tfidf_vectors(
    df: DataFrame, text_column: str, model: TfidfModel, output="features", sign: Column | None = None
) -> DataFrame:
    """L2-normalised sparse ML vectors. With ``sign`` a column of ones follows the
    vocabulary, and the whole row is multiplied by the sign."""
    weighted, parts = _sparse_rows(df, text_column, model, sign)
    vector = _as_vector(parts["size"], parts["indices"], parts["values"])
    return weighted.withColumn(output, vector).drop("_indices", "_raw", "_norm")


def staged_vectors(
    df: DataFrame, text_column: str, model: TfidfModel, name: str, output="features", sign: Column | None = None
) -> DataFrame:
    """``tfidf_vectors``, staged. The vectors are written as the structs they consist of and read back as vectors,
    so no row crosses to Python."""
    weighted, parts = _sparse_rows(df, text_column, model, sign)
    rows = weighted.withColumn(output, F.struct(*[c.alias(part) for part, c in parts.items()]))
    rows = rows.drop("_indices", "_raw", "_norm")
    kinds = [T.StructField(f.name, VectorUDT()) if f.name == output else f for f in rows.schema]
    return stage(rows, name, T.StructType(kinds))


def staged_entries(df: DataFrame, text_column: str, model: TfidfModel, name: str) -> DataFrame:
    """The other columns with ``indices`` and ``values`` of the L2-normalised row, followed by a one; staged."""
    weighted, parts = _sparse_rows(df, text_column, model, F.lit(1.0))
    others = [c for c in df.columns if c != text_column]
    return stage(weighted.select(*others, parts["indices"].alias("indices"), parts["values"].alias("values")), name)


def with_margin(
    df: DataFrame, text_column: str, model: TfidfModel, coefficients: np.ndarray, output="margin"
) -> DataFrame:
    """Adds the product of the L2-normalised row, followed by a one, with the coefficients; row-local and native."""
    return with_margins(df, text_column, model, {output: coefficients})


def with_margins(df: DataFrame, text_column: str, model: TfidfModel, coefficients: dict[str, np.ndarray]) -> DataFrame:
    """``with_margin`` for several coefficients by the column they give; the texts are cut into terms once."""
    weighted, parts = _sparse_rows(df, text_column, model, F.lit(1.0))
    weighted = computed_once(weighted, {"_values": parts["values"], "_at": parts["indices"]})

    def margin(by: Column) -> Column:
        return F.aggregate(F.zip_with("_at", "_values", lambda i, v: F.get(by, i) * v), F.lit(0.0), lambda acc, v: acc + v)

    found = {output: margin(_array_literal(by.tolist(), "double")) for output, by in coefficients.items()}
    return computed_once(weighted, found).drop("_indices", "_raw", "_norm", "_values", "_at")


def extract_text_statistics(df: DataFrame, text_column: str) -> DataFrame:
    """Adds the ten text statistics; row-local and native."""
    require_columns(df, [text_column], "text column")
    return df.withColumns(text_statistics(text_column))


def fit_text_features(df: DataFrame, text_column: str, **options):
    """Fitted model and the frame with text statistics and TF-IDF vectors."""
    model = fit_tfidf(df, text_column, **options)
    return model, transform_text_features(df, text_column, model)


def transform_text_features(df: DataFrame, text_column: str, model: TfidfModel) -> DataFrame:
    """Statistics and vectors with a fitted model; nothing is refitted."""
    return tfidf_vectors(extract_text_statistics(df, text_column), text_column, model, "tfidf")
