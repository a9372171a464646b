"""Context features: availability mask, imputed and scaled numbers, one-hot labels."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from credence.functions.columns import computed_once, known, number
from credence.functions.text import is_blank
from credence.operators.prefix import quantiles
from credence.schema import require_columns
from credence.session import stage

# the categories of a column are broadcast up to this many bytes of text, shuffled above
BROADCAST_BYTES = 64 * 1024 * 1024


def context_availability(
    df: DataFrame, columns, mask="context_available", fraction="context_availability_fraction"
) -> DataFrame:
    """Adds the 0/1 mask and the share of context columns that are present.

    A blank string and a NaN are missing; a numeric 0 is present. Row-local.
    """
    columns = list(columns)
    require_columns(df, columns, "context column")
    if not columns:
        return df.withColumns(
            {mask: F.lit(0).cast("tinyint"), fraction: F.lit(0.0).cast("float")}
        )
    flags = []
    for c in columns:
        present = known(df, c)
        if isinstance(df.schema[c].dataType, T.StringType):
            present = F.coalesce(~is_blank(c), F.lit(False))
        flags.append(present.cast("int"))
    share = (sum(flags[1:], flags[0]) / F.lit(len(columns))).cast("float")
    return df.withColumns({mask: (share > 0).cast("tinyint"), fraction: share})


@dataclass(frozen=True)
class ContextModel:
    """Fitted statistics.

    ``numeric``: per column ``(column, median, mean, scale)``, a few numbers.
    ``fill``: most frequent value per categorical column.
    ``categories``: table ``(column, value)``; it stays a table because a column
    such as a publisher can have very many values. ``sizes`` holds the measured
    number and bytes of each column's categories.
    """

    numeric_columns: tuple
    categorical_columns: tuple
    numeric: list
    fill: dict
    categories: DataFrame | None
    sizes: dict = field(default_factory=dict)

    @property
    def category_count(self) -> int:
        return sum(n for n, _ in self.sizes.values())

    def save(self, spark, path: str) -> None:
        """The category table, and all that is small as one JSON row."""
        if self.categories is not None:
            self.categories.write.mode("overwrite").parquet(f"{path}/categories")
        small = {
            "numeric_columns": self.numeric_columns, "categorical_columns": self.categorical_columns,
            "numeric": self.numeric, "fill": self.fill, "sizes": self.sizes,
        }
        row = spark.createDataFrame([(json.dumps(small),)], "model string")
        row.write.mode("overwrite").text(f"{path}/model")

    @staticmethod
    def load(spark, path: str) -> "ContextModel":
        m = json.loads(spark.read.text(f"{path}/model").first()[0])
        return ContextModel(
            tuple(m["numeric_columns"]), tuple(m["categorical_columns"]), [tuple(x) for x in m["numeric"]],
            m["fill"], spark.read.parquet(f"{path}/categories") if m["categorical_columns"] else None,
            {c: tuple(x) for c, x in m["sizes"].items()},
        )

    def is_small(self, column: str) -> bool:
        return self.sizes[column][1] <= BROADCAST_BYTES


def _as_double(df: DataFrame, columns) -> list:
    return [number(c).alias(c) for c in columns]


def _as_string(columns) -> list:
    return [F.col(c).cast("string").alias(c) for c in columns]


def fit_context(df: DataFrame, *, numeric_columns=(), categorical_columns=()) -> ContextModel:
    """Median, mean and population deviation after imputing; most frequent value
    (tie: smallest) and the observed categories. All-null columns are dropped."""
    numeric_columns, categorical_columns = list(numeric_columns), list(categorical_columns)
    both = numeric_columns + categorical_columns
    if len(set(both)) != len(both):
        raise ValueError("a context column appears in more than one list")
    require_columns(df, both, "context column")

    numeric = []
    if numeric_columns:
        long = df.select(*_as_double(df, numeric_columns)).unpivot(
            [], numeric_columns, "column", "value"
        )
        rows = long.groupBy("column").agg(
            F.count("*").alias("rows"), F.count("value").alias("known"),
            F.avg("value").alias("avg"), F.var_pop("value").alias("var"),
        )
        medians = quantiles(long, "value", {"median": 0.5}, ["column"])
        stats = {r["column"]: r for r in rows.join(medians, "column").collect()}
        for c in numeric_columns:
            if c not in stats:
                continue
            r = stats[c]
            # moments after filling, from the moments of the known values
            share = r["known"] / r["rows"]
            mean = share * r["avg"] + (1 - share) * r["median"]
            var = share * (r["var"] + (r["avg"] - mean) ** 2)
            var += (1 - share) * (r["median"] - mean) ** 2
            scale = var**0.5
            # a column that is constant up to rounding is not scaled
            tiny = 10 * 2.220446049250313e-16 * max(abs(mean), 1.0)
            numeric.append((c, r["median"], mean, scale if scale > tiny else 1.0))

    fill, categories, sizes = {}, None, {}
    if categorical_columns:
        counted = (
            df.select(*_as_string(categorical_columns))
            .unpivot([], categorical_columns, "column", "value")
            .where("value is not null")
            .groupBy("column", "value")
            .agg(F.count("*").alias("n"))
        )
        # fitted once: later transforms must not aggregate the training rows again
        categories = stage(_numbered(counted), "context-categories")
        top = categories.groupBy("column").agg(
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"),
            F.count("*").alias("values"),
            F.sum(F.octet_length("value") + F.octet_length("column")).alias("bytes"),
        ).collect()
        fill = {r["column"]: r["value"] for r in top}
        sizes = {r["column"]: (r["values"], r["bytes"]) for r in top}
        # the fill value is one of the observed values, so imputing adds none
        categories = categories.select("column", "value", "index")
    return ContextModel(
        tuple(numeric_columns), tuple(categorical_columns), numeric, fill, categories, sizes
    )


def _numbered(counted: DataFrame) -> DataFrame:
    """Adds ``index``, the place of a value among the sorted values of its column, from 0.

    Values are dealt into ranges; each range is numbered in its own task, and the sizes of
    the ranges before it, a table of one row a range and column, shift it. No task sees a whole column.
    """
    ranges = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(
        counted.repartitionByRange(ranges, "column", "value").withColumn("_range", F.spark_partition_id()), "category-ranges"
    )
    before = Window.partitionBy("column").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("column", "_range").agg(F.count("*").alias("_size")).select(
        F.col("column").alias("_column"), F.col("_range").alias("_from"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("column", "_range").orderBy("value")
    local = dealt.withColumn("_place", F.row_number().over(inside) - 1)
    shifted = local.join(F.broadcast(starts), (F.col("column") == F.col("_column")) & (F.col("_range") == F.col("_from")))
    return shifted.select("column", "value", "n", (F.col("_place") + F.col("_start")).cast("int").alias("index"))


def _numeric_values(model: ContextModel) -> dict:
    return {
        c: (F.coalesce(number(c), F.lit(float(median))) - F.lit(float(mean)))
        / F.lit(float(scale))
        for c, median, mean, scale in model.numeric
    }


def context_numeric(df: DataFrame, id_column: str, model: ContextModel) -> DataFrame:
    """Long ``(id, feature, value)`` rows of the scaled numeric block; row-local."""
    values = _numeric_values(model)
    if not values:
        return df.select(
            id_column, F.lit("").alias("feature"), F.lit(0.0).alias("value")
        ).where(F.lit(False))
    named = df.select(id_column, *[v.alias(f"numeric__{c}") for c, v in values.items()])
    return named.unpivot([id_column], [f"numeric__{c}" for c in values], "feature", "value")


def _filled(column: str, model: ContextModel):
    return F.coalesce(F.col(column).cast("string"), F.lit(model.fill[column]))


def context_onehot(df: DataFrame, id_column: str, model: ContextModel) -> DataFrame:
    """Long ``(id, feature, 1.0)`` rows; a category not seen in fitting has no row.

    Columns with few categories meet a broadcast table, the others a shuffled one:
    at most two passes over the rows.
    """
    fitted = [c for c in model.categorical_columns if c in model.fill]
    groups = [[c for c in fitted if model.is_small(c) == small] for small in (True, False)]
    out = None
    for columns, small in zip(groups, (True, False)):
        if not columns:
            continue
        long = df.select(id_column, *[_filled(c, model).alias(c) for c in columns]).unpivot(
            [id_column], columns, "column", "value"
        )
        categories = model.categories.where(F.col("column").isin(columns)).select("column", "value")
        seen = long.join(F.broadcast(categories) if small else categories, ["column", "value"], "left_semi")
        rows = seen.select(
            id_column,
            F.concat(F.lit("categorical__"), "column", F.lit("_"), "value").alias("feature"),
            F.lit(1.0).alias("value"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def transform_context(df: DataFrame, id_column: str, model: ContextModel) -> DataFrame:
    """Numeric block then categorical block as long rows (zeros are left out of the
    categorical block). Nothing fitted gives an empty result."""
    out = context_numeric(df, id_column, model)
    if model.fill:
        out = out.unionByName(context_onehot(df, id_column, model))
    return out


def fit_context_features(df: DataFrame, id_column: str, **columns):
    """Fitted model and the long feature rows of the same frame."""
    model = fit_context(df, **columns)
    return model, transform_context(df, id_column, model)


def feature_count(model: ContextModel) -> int:
    return len(model.numeric) + model.category_count


def feature_names(model: ContextModel) -> list:
    """Feature names in column order: numeric, then categories sorted per column. One
    name per category comes to the driver; ``feature_count`` needs none."""
    names = [f"numeric__{c}" for c, *_ in model.numeric]
    if not model.fill:
        return names
    by_column: dict = {}
    for r in model.categories.collect():
        by_column.setdefault(r["column"], []).append((r["index"], r["value"]))
    for c in model.categorical_columns:
        values = [v for _, v in sorted(by_column.get(c, []))]
        names += [f"categorical__{c}_{v}" for v in values]
    return names


def context_sparse(df: DataFrame, model: ContextModel, output="context_sparse") -> DataFrame:
    """Adds ``struct<size, indices, values>`` in the order of ``feature_names``.

    Each category is looked up by a join on its column's table of indices, so neither the
    plan nor the work of a row grows with the number of categories. The gated model reads this form as it is.
    """
    values = _numeric_values(model)
    numeric = [values[c].cast("float") for c, *_ in model.numeric]
    fitted = [c for c in model.categorical_columns if c in model.fill]
    start, found = len(numeric), []
    for c in fitted:
        table = model.categories.where(F.col("column") == c).select(
            F.col("value").alias(f"_value_{c}"),
            (F.col("index") + start).alias(f"_index_{c}"),
        )
        start += model.sizes[c][0]
        found.append(f"_index_{c}")
        table = F.broadcast(table) if model.is_small(c) else table
        df = df.join(table, _filled(c, model) == F.col(f"_value_{c}"), "left").drop(f"_value_{c}")
    indices = F.array_compact(F.array(*[F.lit(i) for i in range(len(numeric))], *found).cast("array<int>"))
    ones = F.transform(F.array_compact(F.array(*found).cast("array<int>")), lambda _: F.lit(1.0).cast("float"))
    row = F.struct(
        F.lit(start).alias("size"), indices.alias("indices"),
        F.concat(F.array(*numeric).cast("array<float>"), ones).alias("values"),
    )
    return df.withColumn(output, row).drop(*found)


def context_vector(df: DataFrame, model: ContextModel, output="context_features") -> DataFrame:
    """Dense ``array<float>`` in the order of ``feature_names``, from the sparse form; for few categories."""
    sparse = computed_once(context_sparse(df, model, "_sparse"), {"_row": F.col("_sparse")}).drop("_sparse")
    numeric = len(model.numeric)
    hot = F.slice("_row.indices", numeric + 1, max(1, len(model.fill)))
    zeros = F.when(
        F.col("_row.size") > numeric,
        F.transform(
            F.sequence(F.lit(numeric), F.col("_row.size") - 1),
            lambda i: F.array_contains(hot, i).cast("float"),
        ),
    ).otherwise(F.array().cast("array<float>"))
    first = F.slice("_row.values", 1, numeric) if numeric else F.array().cast("array<float>")
    return sparse.withColumn(output, F.concat(first, zeros)).drop("_row")
