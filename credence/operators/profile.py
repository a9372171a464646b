"""Profiles, distributions and histograms of standard and processed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from credence.functions.columns import join_by, known
from credence.functions.text import is_blank
from credence.operators.prefix import quantiles
from credence.schema import COUNT_COLUMNS, FLAG_COLUMNS, STANDARD_COLUMNS

# ---- fixed values -----------------------------------------------------------
HISTOGRAM_BINS = 40
GATE_BINS = 30
CLIP_SHARE = 0.99
GATE_ZERO_TOLERANCE = 1e-8
# -----------------------------------------------------------------------------


def _long(row: DataFrame, columns, names, by=()) -> DataFrame:
    """Turn a narrow aggregate into long ``(by, names[0], value)`` rows."""
    return row.unpivot(list(by), list(columns), *names)


def _ordered(report: DataFrame, keys) -> DataFrame:
    """A short report in the order of its keys, nulls last."""
    return report.orderBy(*[F.asc_nulls_last(k) for k in keys])


def profile_missing(df: DataFrame, columns=STANDARD_COLUMNS) -> DataFrame:
    """Missing count (null or NaN) and percent (2 places) per column, in one scan; an
    empty table has no percent. The fullest columns come first."""
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(~known(df, c)).alias(c) for c in columns]
    )
    long = counts.unpivot(["_rows"], list(columns), "column", "missing")
    return long.select(
        "column", "missing", F.round(F.try_divide(F.col("missing"), F.col("_rows")) * 100, 2).alias("pct")
    ).orderBy("missing", "column")


def _repeats(df: DataFrame, key) -> DataFrame:
    """Rows beyond the first of their key; null is one key."""
    return (
        df.select(key.alias("_k")).groupBy("_k").count()
        .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeats"))
    )


def profile_duplicates(df: DataFrame) -> DataFrame:
    """Rows, duplicate ids, duplicate non-blank texts and blank texts, one row."""
    blank = F.coalesce(is_blank("text"), F.lit(True))
    digest = F.unhex(F.sha2(F.col("text"), 256))
    return df.agg(
        F.count("*").alias("rows"), F.count_if(blank).alias("blank_texts")
    ).withColumns(
        {
            "duplicate_ids": _repeats(df, F.col("id")).scalar(),
            "duplicate_texts": _repeats(df.where(~blank), digest).scalar(),
        }
    )


def profile_labels(df: DataFrame, label="label", by=()) -> DataFrame:
    """Label counts and percent (2 places), null included."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    if by:
        # a few rows per group: labels of a standard table are 0, 1 or null
        counts = join_by(counts, df.groupBy(*by).agg(F.count("*").alias("_rows")), by)
    else:
        counts = counts.withColumn("_rows", df.agg(F.count("*")).scalar())
    shares = counts.select(*by, label, "n", F.round(F.col("n") / F.col("_rows") * 100, 2).alias("pct"))
    return _ordered(shares, [*by, label])


def profile_context(df: DataFrame, flags=FLAG_COLUMNS, by=(), digits=3) -> DataFrame:
    """Share of rows on which each context flag is set."""
    shares = df.groupBy(*by).agg(
        *[F.round(F.avg(F.col(c).cast("double")), digits).alias(c) for c in flags]
    )
    return _long(shares, flags, ("flag", "share"), by)


def inspect_dataframe(df: DataFrame, name="") -> DataFrame:
    """The whole profile as long ``(name, section, key, value)`` rows, in four passes: one
    aggregate for all scalars, one for the labels, one each for repeated ids and texts."""
    types = [(c, t) for c, t in df.dtypes if c in STANDARD_COLUMNS]
    fixed = [("dtypes", c, t) for c, t in types] + [("shape", "columns", str(len(types)))]
    blank = F.coalesce(is_blank("text"), F.lit(True))
    digest = F.unhex(F.sha2(F.col("text"), 256))
    total = F.count("*")
    string = lambda v: v.cast("string")
    cells = [("rows", "rows", string(total)), ("rows", "blank_texts", string(F.count_if(blank)))]
    for c, _ in types:
        missing = F.count_if(~known(df, c))
        cells.append(("missing", c, string(missing)))
        cells.append(("missing_pct", c, string(F.round(F.try_divide(missing, total) * 100, 2))))
    for c in FLAG_COLUMNS:
        cells.append(("context_available", c, string(F.round(F.avg(F.col(c).cast("double")), 3))))
    labels = df.groupBy("label").agg(total.alias("n"))
    # two or three labels: the list is as short as the label set
    listed = labels.agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("l"), F.sum("n").alias("rows"))
    shown = lambda x: F.coalesce(string(x["label"]), F.lit("null"))
    entry = lambda section, key, value: F.struct(
        F.lit(section).alias("section"), key.alias("key"), value.alias("value")
    )
    of_labels = listed.select(
        F.explode(
            F.concat(
                F.transform("l", lambda x: entry("label_counts", shown(x), string(x["n"]))),
                F.transform("l", lambda x: entry("label_pct", shown(x), string(F.round(x["n"] / F.col("rows") * 100, 2)))),
            )
        ).alias("e")
    ).select("e.*")
    scalars = df.agg(F.array(*[entry(s, F.lit(k), v) for s, k, v in cells]).alias("e")).select(F.inline("e"))
    repeats = [
        _repeats(rows, key).select(F.lit("rows").alias("section"), F.lit(k).alias("key"), string(F.col("repeats")).alias("value"))
        for k, rows, key in (
            ("duplicate_ids", df, F.col("id")), ("duplicate_texts", df.where(~blank), digest)
        )
    ]
    out = df.sparkSession.createDataFrame(fixed, "section string, key string, value string")
    for part in (scalars, of_labels, *repeats):
        out = out.unionByName(part)
    return out.select(F.lit(name).alias("name"), "*")


def class_distribution(df: DataFrame, by=("dataset",), label="label") -> DataFrame:
    """Class counts and shares per dataset."""
    by = list(by)
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    rows = counts.groupBy(*by).agg(F.sum("n").alias("_rows"))
    shares = join_by(counts, rows, by).select(*by, label, "n", (F.col("n") / F.col("_rows")).alias("share"))
    return _ordered(shares, [*by, label])


def split_label_pivot(df: DataFrame, labels=(0, 1)) -> DataFrame:
    """Rows per split and label; a missing cell is 0."""
    counts = df.groupBy("split").agg(
        *[F.count_if(F.col("label") == v).alias(f"label_{v}") for v in labels]
    )
    return _ordered(counts, ["split"])


def describe_by_label(df: DataFrame, columns=("text_len", "word_count"), by=("label",)) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of each column per label."""
    by = list(by)
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        by, list(columns), "column", "value"
    )
    keys = [*by, "column"]
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = quantiles(long, "value", {"q25": 0.25, "q50": 0.50, "q75": 0.75}, keys)
    return _ordered(join_by(moments, quartiles, keys), keys)


def clip_tail(df: DataFrame, value: str, share=CLIP_SHARE, by=()) -> DataFrame:
    """Rows up to the given quantile of ``value`` (linear interpolation), of the whole
    table or of each group."""
    cut = quantiles(df, value, {"_cut": share}, by)
    if by:
        return join_by(df, cut, by).where(F.col(value) <= F.col("_cut")).drop("_cut")
    return df.where(F.col(value) <= cut.scalar())


def histogram(df: DataFrame, value: str, bins: int, by=(), range_by=()) -> DataFrame:
    """Equal-width bins, last bin closed, counted per group.

    The range is that of the whole table, or of each ``range_by`` group. A range of one
    value is widened by a half on either side.
    """
    by = list(by)
    rows = df.where(known(df, value)).withColumn("_x", F.col(value).cast("double"))
    span = rows.groupBy(*range_by).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    flat = F.col("_high") == F.col("_low")
    span = span.withColumns(
        {
            "_from": F.when(flat, F.col("_low") - 0.5).otherwise(F.col("_low")),
            "_width": F.when(flat, F.lit(1.0)).otherwise(F.col("_high") - F.col("_low")),
        }
    ).drop("_low", "_high")
    if range_by:
        rows = join_by(rows, span, range_by)
    else:
        rows = rows.withColumn("_span", span.select(F.struct("_from", "_width")).scalar()).select("*", "_span.*")
    index = F.least(F.floor((F.col("_x") - F.col("_from")) / F.col("_width") * bins), F.lit(bins - 1))
    counts = rows.withColumn("bin", index.cast("int")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return _ordered(counts, [*by, "bin"])


def hist_by_label(df: DataFrame, column: str, bins=HISTOGRAM_BINS, share=CLIP_SHARE, by=()) -> DataFrame:
    """Per label (and ``by``), over the clipped range of the table (or of each ``by`` group)."""
    return histogram(clip_tail(df, column, share, by), column, bins, [*by, "label"], by)


def hist_engagement(df: DataFrame, columns=COUNT_COLUMNS, bins=HISTOGRAM_BINS) -> DataFrame:
    """Histogram of ``log1p`` of each non-null count on its own range, over rows with
    engagement; a column without any value gives no rows."""
    rows = df.where("has_engagement").select(*columns).unpivot([], list(columns), "column", "value")
    logs = rows.select("column", F.log1p("value").alias("x"))
    return histogram(logs, "x", bins, by=["column"], range_by=["column"])


def mask_counts(df: DataFrame, mask="context_available") -> DataFrame:
    """Rows and percent with and without context."""
    counts = df.groupBy(mask).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    return counts.withColumn("_rows", total).select(
        mask, "n", (F.col("n") / F.col("_rows") * 100).alias("pct")
    )


def gate_stats(df: DataFrame, gate="gate", mask="context_mask") -> DataFrame:
    """Gate mean, population std, min, max and the all-zero test per mask value."""
    return df.groupBy(mask).agg(
        F.count("*").alias("n"),
        F.avg(gate).alias("mean"),
        F.stddev_pop(gate).alias("std"),
        F.min(gate).alias("min"),
        F.max(gate).alias("max"),
        F.bool_and(F.abs(gate) <= GATE_ZERO_TOLERANCE).alias("all_zero"),
    )


def gate_hist(df: DataFrame, gate="gate", mask="context_mask", bins=GATE_BINS) -> DataFrame:
    """Each mask value on its own range."""
    return histogram(df, gate, bins, by=[mask], range_by=[mask])


def preview(df: DataFrame, n=5, order="_ord") -> DataFrame:
    return df.orderBy(order).limit(n)
