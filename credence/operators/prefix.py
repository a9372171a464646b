"""Running sums and exact quantiles over a whole table, without one big sort task.

A window with no partition key runs in a single task. Here the rows are cut into
value ranges (bounds from a one-pass sketch; any bounds give the same result),
each range is summed in its own task, and a small table of range totals supplies
the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from credence.functions.columns import join_by
from credence.operators.ranks import MOST_INTERVALS, values_of_ranks
from credence.session import stage


def _range_count(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _range_of(value: str, ranges: int) -> Column:
    """How many of the sorted ``_bounds`` lie below the value: first among every k-th
    bound, then among the k that follow, so a row looks at about two roots of them."""
    k = max(1, int(ranges**0.5))
    coarse = F.size(F.filter("_coarse", lambda b: b < F.col(value)))
    fine = F.slice("_bounds", coarse * k + 1, k)
    return coarse * k + F.size(F.filter(fine, lambda b: b < F.col(value)))


def running_sums(
    df: DataFrame, value: str, sums: dict, by=(), descending=False, ranges: int | None = None
) -> DataFrame:
    """Add inclusive running sums in the order of ``value``.

    ``df`` has one row per ``(by, value)``; ``sums`` maps a new column to the
    column it accumulates. A null group is a group like any other.
    """
    by = list(by)
    ranges = ranges or _range_count(df)
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        bounds = df.agg(F.percentile_approx(value, shares, 10000)).scalar()
        k = max(1, int(ranges**0.5))
        df = df.withColumn("_bounds", bounds).withColumn(
            "_coarse", F.filter("_bounds", lambda _, i: i % k == k - 1)
        ).withColumn("_range", _range_of(value, ranges)).drop("_bounds", "_coarse")
    else:
        df = df.withColumn("_range", F.lit(0))

    inside = Window.partitionBy(*by, "_range").orderBy(
        F.desc(value) if descending else F.asc(value)
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at most `ranges` rows per group
    before = Window.partitionBy(*by).orderBy(
        F.desc("_range") if descending else F.asc("_range")
    ).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, "_range").agg(
        *[F.sum(c).alias(f"_total_{out}") for out, c in sums.items()]
    )
    offsets = totals.select(
        *by,
        "_range",
        *[
            F.coalesce(F.sum(f"_total_{out}").over(before), F.lit(0)).alias(f"_offset_{out}")
            for out in sums
        ],
    )
    local = df.withColumns({f"_local_{out}": F.sum(c).over(inside) for out, c in sums.items()})
    joined = join_by(local, offsets, [*by, "_range"])
    return joined.select(
        *[c for c in df.columns if c != "_range"],
        *[(F.col(f"_local_{out}") + F.col(f"_offset_{out}")).alias(out) for out in sums],
    )


def quantiles(df: DataFrame, value: str, probs: dict, by=(), ranges: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    ``probs`` maps an output column to a probability; nulls are ignored. The ranks are found by rounds of counting
    (``ranks``). Where there are more groups than the driver should know, or ``ranges`` is given, equal values are
    collapsed and summed up in value ranges instead, with the same result.
    """
    by = list(by)
    if ranges is None:
        narrow = stage(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_value")), "values")
        most = MOST_INTERVALS // (2 * max(1, len(probs)))
        sizes = narrow.groupBy(*by).agg(F.count("*").alias("_n")).limit(most + 1).collect()
        if len(sizes) <= most:
            return _counted_quantiles(narrow, probs, by, {tuple(r[c] for c in by): r["_n"] for r in sizes if r["_n"]})
        df, value = narrow, "_value"
    return _collapsed_quantiles(df, value, probs, by, ranges)


def _counted_quantiles(narrow: DataFrame, probs: dict, by: list, sizes: dict) -> DataFrame:
    places = {g: {name: (n - 1) * float(p) for name, p in probs.items()} for g, n in sizes.items()}
    wanted = {
        g: (n, {min(int(x) + k, n - 1) for x in places[g].values() for k in (0, 1)}) for g, n in sizes.items()
    }
    found = values_of_ranks(narrow, "_value", by, wanted)
    rows = []
    for g, n in sizes.items():
        at = found[g]
        cut = {}
        for name, x in places[g].items():
            low, high = at[int(x)], at[min(int(x) + 1, n - 1)]
            cut[name] = low + (high - low) * (x - int(x))
        rows.append((*g, *cut.values()))
    kinds = [f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in by] + [f"`{name}` double" for name in probs]
    return narrow.sparkSession.createDataFrame(rows, ", ".join(kinds))


def _collapsed_quantiles(df: DataFrame, value: str, probs: dict, by: list, ranges: int | None) -> DataFrame:
    """Equal values are collapsed before anything is ordered."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running_sums(counted, value, {"_upto": "_n"}, by, ranges=ranges)
    sizes = counted.groupBy(*by).agg(F.sum("_n").alias("_size"))
    if by:
        ranked = join_by(ranked, sizes, by)
    else:
        ranked = ranked.withColumn("_size", sizes.scalar())

    picks = []
    for name, p in probs.items():
        position = (F.col("_size") - 1) * F.lit(float(p))
        lower = F.floor(position)
        upper = F.least(lower + 1, F.col("_size") - 1)
        # the value at 0-based rank r is the smallest with a running count above r
        picks += [
            F.min(F.when(F.col("_upto") > lower, F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > upper, F.col(value))).alias(f"_hi_{name}"),
            F.max(position - lower).alias(f"_frac_{name}"),
        ]
    picked = ranked.groupBy(*by).agg(*picks)
    return picked.select(
        *by,
        *[
            (
                F.col(f"_lo_{n}")
                + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_frac_{n}")
            ).cast("double").alias(n)
            for n in probs
        ],
    )
