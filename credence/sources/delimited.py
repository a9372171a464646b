"""Delimited text files with per-file headers and pandas null tokens, read block by block.

Quoted cells may hold line breaks, so a line of such a file is a record only if it begins outside quotes, which depends on
all lines before it. Spark's own reader therefore gives a multi-line file to one task. Here the lines are read in blocks like any
text, and what a line does to the quotes is put as a function of how it begins: (end if it begins outside quotes, end if it begins
inside). Such functions compose, first along the lines of a block, then along the blocks of a file (one small row each),
and that tells for every line how it begins and of which record it is. Only lines of records that have several are grouped again.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from credence.session import stage

# ---- fixed values: tokens that a default pandas CSV read takes as missing ----
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# -----------------------------------------------------------------------------
OPENING, OTHER = "\x01", "\x02"
BOM = "﻿"


def _ends(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line ends inside quotes, if it begins outside and if it begins inside.

    A quote opens a cell at its first place only, elsewhere it is a sign like any other; inside quotes the next one
    closes, and two are one sign of the cell.
    """
    plain = F.replace(F.translate(line, OPENING + OTHER, ""), F.lit('""'), F.lit(""))
    first = F.regexp_replace(plain, f'(^|{re.escape(sep)})"', f"$1{OPENING}")
    quotes = F.regexp_replace(F.replace(first, F.lit('"'), F.lit(OTHER)), f"[^{OPENING}{OTHER}]+", "")

    def walk(begin: int) -> Column:
        step = lambda inside, q: F.when(inside == 1, 0).otherwise((q == OPENING).cast("int"))
        walked = F.aggregate(F.split(quotes, ""), F.lit(begin), step)
        return F.when(F.contains(line, F.lit('"')) & (quotes != ""), walked).otherwise(begin)

    return walk(0), walk(1)


def _begins(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``b0`` and ``b1``: how a row begins if the first row of its group begins outside or inside quotes, from
    the functions ``e0``, ``e1`` of the rows before it.

    A row with equal ends forgets what was before; one with crossed ends changes it. So what counts is the last row that
    forgets and the number of changes, both plain windows.
    """
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    changes = F.coalesce(F.sum((F.col("e0") > F.col("e1")).cast("int")).over(before), F.lit(0)) % 2
    rows = rows.withColumn("_changes", changes)
    known = F.when(F.col("e0") == F.col("e1"), (F.col("e0") + F.col("_changes")) % 2)
    rows = rows.withColumn("_known", known).withColumn("_known", F.last("_known", ignorenulls=True).over(before))
    begin = lambda first: ((F.coalesce("_known", F.lit(first)) + F.col("_changes")) % 2).cast("int")
    return rows.withColumns({"b0": begin(0), "b1": begin(1)}).drop("_changes", "_known")


def read_records(spark: SparkSession, paths: list[str] | str, sep=",") -> DataFrame:
    """(_file, _number, _row, _record) and the partition columns of the paths: the records of each file, unparsed.

    ``_number`` counts them from 0, the header; ``_row`` grows along a file. Records end with a line feed, with or
    without a carriage return; empty lines between records are none.
    """
    plus = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    text = spark.read.option("lineSep", "\n").text(paths)
    folders = [c for c in text.columns if c != "value"]
    line = F.regexp_replace("value", "\r$", "")
    e0, e1 = _ends(line, sep)
    lines = text.select(
        *folders, F.url_decode(plus).alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value", e0.alias("e0"), e1.alias("e1"), (line != "").alias("filled"),
    )
    in_block = Window.partitionBy("file", "block").orderBy("at")
    upto = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = _begins(lines, ["file", "block"], "at").withColumns(
        {
            "place": F.row_number().over(in_block) - 1,
            "n0": F.sum((F.col("filled") & (F.col("b0") == 0)).cast("long")).over(upto),
            "n1": F.sum((F.col("filled") & (F.col("b1") == 0)).cast("long")).over(upto),
        }
    )
    counted = stage(counted.drop("at"), "delimited-lines")
    end = lambda b: F.max_by(F.when(F.col(b) == 0, F.col("e0")).otherwise(F.col("e1")), "place")
    blocks = counted.groupBy("file", "block").agg(
        end("b0").alias("e0"), end("b1").alias("e1"), F.max("n0").alias("n0"), F.max("n1").alias("n1")
    )
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    records = F.when(F.col("b0") == 0, F.col("n0")).otherwise(F.col("n1"))
    blocks = _begins(blocks, ["file"], "block").select(
        F.col("file").alias("b_file"), F.col("block").alias("b_block"), F.col("b0").alias("entry"),
        F.coalesce(F.sum(records).over(ahead), F.lit(0)).alias("earlier"),
    )
    placed = counted.join(blocks, (F.col("file") == F.col("b_file")) & (F.col("block") == F.col("b_block")))
    by_entry = lambda a, b: F.when(F.col("entry") == 0, F.col(a)).otherwise(F.col(b))
    begin = by_entry("b0", "b1")
    placed = placed.select(
        *folders, F.col("file").alias("_file"), (F.col("earlier") + by_entry("n0", "n1") - 1).alias("_number"),
        (F.col("block") + F.col("place")).alias("_row"), "value",
        F.when((begin == 0) & ~F.col("filled"), "none").when((begin == 0) & (F.col("e0") == 0), "whole").otherwise("part").alias("kind"),
    ).where("_number >= 0")
    tidy = lambda c: F.regexp_replace(c, "\r$", "")
    whole = placed.where("kind = 'whole'").select(*folders, "_file", "_number", "_row", tidy("value").alias("_record"))
    parts = F.array_sort(F.collect_list(F.struct("_row", "value")))
    several = placed.where("kind = 'part'").groupBy(*folders, "_file", "_number").agg(
        F.min("_row").alias("_row"), tidy(F.array_join(F.transform(parts, lambda x: x["value"]), "\n")).alias("_record")
    )
    return whole.unionByName(several)


def headers(records: DataFrame, sep=",") -> list[tuple[str, tuple[str, ...]]]:
    """Path and column names of each file that has any record."""
    first = records.where("_number = 0").select("_file", "_record").orderBy("_file")
    return [
        (r["_file"], tuple(next(csv.reader([r["_record"].removeprefix(BOM)], delimiter=sep)))) for r in first.collect()
    ]


def parse(records: DataFrame, schema: str, sep=",", **options) -> DataFrame:
    """Data records as a struct ``_cells`` of the declared columns, next to what names them."""
    cells = F.from_csv("_record", schema, {"sep": sep, "quote": '"', "escape": '"', **options})
    return records.where("_number > 0").withColumn("_cells", cells).drop("_record")


def read_delimited(
    spark: SparkSession, paths: list[str], sep=",", numbered: str | None = None
) -> DataFrame:
    """All files as strings plus ``_file`` (decoded path) and ``_row``, which grows along a file.

    Files may differ in their header; each header's files are parsed with it. A file without the column ``numbered`` gets
    its row numbers there.
    """
    records = read_records(spark, paths, sep)
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, names in headers(records, sep):
        groups.setdefault(names, []).append(path)
    frames = []
    for names, files in groups.items():
        own = records if len(groups) == 1 else records.where(F.col("_file").isin(files))
        rows = parse(own, ", ".join(f"`{h}` string" for h in names), sep)
        cell = lambda h: F.col("_cells").getField(h)
        cells = [F.when(~cell(h).isin(NA_TOKENS), cell(h)).alias(h) for h in names]
        if numbered and numbered not in names:
            cells.append((F.col("_number") - 1).cast("string").alias(numbered))
        frames.append(rows.select(*cells, "_file", "_row"))
    if not frames:
        return spark.createDataFrame([], "_file string, _row long")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
