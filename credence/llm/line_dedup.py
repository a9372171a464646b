"""Removal of repeated passages by overlapping three-line windows.

The non-blank lines of a text, trimmed, form overlapping windows of three. A window
that stands anywhere earlier in the corpus (documents in the order of their id, then by line) marks its
three lines; marked lines are dropped, and what is left keeps its line breaks and blank lines.
A text with fewer than three such lines has no window and stays as it is.

Windows are compared by 128 bits of hash. Counting them shuffles one pre-aggregated row
per distinct window and map task, so a window that a third of all documents hold stays small; only
positions of later occurrences are joined back, and the texts move once.

Defined cases: null texts stay null; empty ones stay empty. Rows equal in id and text
are one document, and none of them counts as later than the other. Null ids come first.
Extra columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import let, row_key, text_or_empty
from credence.session import stage

LINES = 3
BLANKS = " \t\r\x0b\x0c"


def lines_of(text: Column) -> Column:
    """(n, line) of the non-blank lines, n counting all lines from 0."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("n"), F.trim(x, F.lit(BLANKS)).alias("line")))
    return F.filter(numbered, lambda x: x["line"] != "")


def _windows(lines: Column, size: int) -> Column:
    at = lambda i, k: F.get(lines, i + k)["line"]
    starts = F.sequence(F.lit(0), F.size(lines) - size)
    return F.when(
        F.size(lines) >= size,
        F.transform(
            starts,
            lambda i: F.struct(
                i.alias("i"),
                F.xxhash64(*[at(i, k) for k in range(size)]).alias("h1"),
                F.xxhash64(F.lit(1), *[at(i, k) for k in range(size)]).alias("h2"),
            ),
        ),
    )


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = LINES) -> DataFrame:
    """(_id, _th, starts): where a document repeats an earlier window, by index among its non-blank lines."""
    found = docs.select(
        *row_key(id_col, text_col), F.explode(let(lines_of(text_or_empty(text_col)), lambda x: _windows(x, size))).alias("x")
    ).select("_id", "_th", "x.*")
    windows = stage(found, "line-windows")
    place = F.struct("_id", "_th", "i")
    first = (
        windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first"))
        .where("n > 1").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    )
    again = windows.join(first, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    return again.where(~place.eqNullSafe(F.col("first"))).groupBy("_id", "_th").agg(F.collect_set("i").alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = LINES) -> DataFrame:
    """``docs`` as struct ``row`` with ``kept`` (its text without later passages), ``n_lines`` and ``n_removed``."""
    marks = later_windows(docs, id_col, text_col, size)
    rows = docs.select(F.struct("*").alias("row"), *row_key(id_col, text_col))
    marks = marks.select(F.col("_id").alias("m_id"), F.col("_th").alias("m_th"), "starts")
    joined = rows.join(marks, rows["_id"].eqNullSafe(marks["m_id"]) & (rows["_th"] == marks["m_th"]), "left")
    text = F.col(f"row.{text_col}")

    def cut(lines: Column) -> Column:
        covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + size - 1))))
        gone = F.transform(F.sort_array(covered), lambda i: F.get(lines, i)["n"])
        left = F.array_except(F.sequence(F.lit(0), F.size(F.split(text, "\n")) - 1), gone)
        return F.struct(
            let(F.split(text, "\n"), lambda every: F.array_join(F.transform(left, lambda n: F.get(every, n)), "\n")).alias("kept"),
            F.size(gone).alias("n_removed"),
        )

    result = F.when(F.col("starts").isNotNull(), let(lines_of(text), cut))
    return joined.select(
        "row", F.size(lines_of(F.coalesce(text, F.lit("")))).cast("long").alias("n_lines"), result.alias("r")
    ).select(
        "row", "n_lines", F.coalesce(F.col("r.n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("r.kept", text).alias("kept"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = LINES) -> DataFrame:
    """The input with repeated passages cut; a text of which nothing is left goes, one empty before stays."""
    done = dedup_lines(docs, id_col, text_col, size)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.col("kept"), F.lit(BLANKS + "\n")) == "")
    return done.where(~F.coalesce(emptied, F.lit(False))).select(
        F.col("row").withField(text_col, F.col("kept")).alias("row")
    ).select("row.*")
