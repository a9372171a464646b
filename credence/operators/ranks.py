"""Values of given ranks by rounds of counting: no value is shuffled and nothing is sorted as a whole.

Every wanted rank has an open interval of values that holds it, at first all values of its group. A round cuts each interval at
the marks of a mergeable sketch and counts, exactly, the rows below, at and between the marks; the rank then lies on a
mark, which is the answer, or between two, a small share of the rows. When few rows are left they are fetched. The sketch only
says where to cut, so the answer is exact for any marks; a bad mark costs a round.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Marks per interval and round.
MARKS = 128
#: Rows of an interval that are fetched instead of counted further.
FETCHED = 10_000
#: Groups and ranks that the driver keeps track of, at most.
MOST_INTERVALS = 1_000


@dataclass(frozen=True)
class Interval:
    """Rows of ``group`` with values strictly between ``low`` and ``high`` (None: unbounded); ``below`` of the group's rows are not above ``low``."""

    group: tuple
    rank: int
    low: float | None
    high: float | None
    below: int
    rows: int


def _inside(rows: DataFrame, value: str, by: list[str], intervals: list[Interval]) -> DataFrame:
    """(_i, value) for each row and interval it lies in."""
    kinds = [f"`_g{k}` {rows.schema[c].dataType.simpleString()}" for k, c in enumerate(by)]
    table = rows.sparkSession.createDataFrame(
        [(*x.group, i, x.low, x.high) for i, x in enumerate(intervals)],
        ", ".join([*kinds, "_i int, _low double, _high double"]),
    )
    meets = (F.col("_low").isNull() | (F.col(value) > F.col("_low"))) & (F.col("_high").isNull() | (F.col(value) < F.col("_high")))
    for k, c in enumerate(by):
        meets &= F.col(c).eqNullSafe(F.col(f"_g{k}"))
    # bounded by MOST_INTERVALS
    return rows.join(F.broadcast(table), meets).select("_i", F.col(value).alias("_v"))


def _narrowed(x: Interval, marks: list[tuple[float, int, int]]) -> Interval | float:
    """The value of the rank, or the interval between two marks that holds it; ``marks`` are (value, rows below, rows at)."""
    wanted = x.rank - x.below  # place among the rows of the interval
    low, high, before, upto = x.low, x.high, 0, x.rows
    for mark, under, at in marks:
        if under <= wanted < under + at:
            return mark
        if wanted >= under + at:
            low, before = mark, under + at
        else:
            high, upto = mark, under
            break
    return replace(x, low=low, high=high, below=x.below + before, rows=upto - before)


def values_of_ranks(rows: DataFrame, value: str, by: list[str], wanted: dict[tuple, tuple[int, set[int]]]) -> dict[tuple, dict[int, float]]:
    """``{group: {rank: value}}`` of 0-based ranks among the values of each group, given ``{group: (rows, ranks)}``.

    ``rows`` holds no null and is read twice a round.
    """
    found: dict[tuple, dict[int, float]] = {g: {} for g in wanted}
    todo = [Interval(g, r, None, None, 0, n) for g, (n, ranks) in wanted.items() for r in sorted(ranks)]
    while todo:
        unique = {(x.group, x.low, x.high): x for x in todo}  # ranks of one interval share its counts
        intervals = list(unique.values())
        number = {k: i for i, k in enumerate(unique)}
        inside = _inside(rows, value, by, intervals)
        few = [i for i, x in enumerate(intervals) if x.rows <= FETCHED]
        fetched: dict[int, np.ndarray] = {}
        if few:
            table = inside.where(F.col("_i").isin(few)).toArrow()  # at most FETCHED an interval
            owner, values = table["_i"].to_numpy(), table["_v"].to_numpy()
            fetched = {i: np.sort(values[owner == i]) for i in few}
        marks: dict[int, list[tuple[float, int, int]]] = {}
        if len(few) < len(intervals):
            many = inside.where(~F.col("_i").isin(few)) if few else inside
            shares = [k / MARKS for k in range(MARKS + 1)]
            sketch = many.groupBy("_i").agg(F.percentile_approx("_v", shares, 10_000).alias("m")).collect()
            cuts = {r["_i"]: sorted(set(r["m"])) for r in sketch}
            table = rows.sparkSession.createDataFrame(list(cuts.items()), "_j int, _marks array<double>")
            placed = many.join(F.broadcast(table), F.col("_i") == F.col("_j"))
            # 2k for a value between marks k - 1 and k, 2k + 1 for one that is mark k
            under = F.size(F.filter("_marks", lambda m: m < F.col("_v")))
            cell = 2 * under + F.array_contains("_marks", F.col("_v")).cast("int")
            counted: dict[int, dict[int, int]] = {i: {} for i in cuts}
            for r in placed.groupBy("_i", cell.alias("cell")).agg(F.count("*").alias("n")).collect():
                counted[r["_i"]][r["cell"]] = r["n"]
            for i, values in cuts.items():
                marks[i], below = [], 0
                for k, v in enumerate(values):
                    below += counted[i].get(2 * k, 0)
                    at = counted[i].get(2 * k + 1, 0)
                    marks[i].append((v, below, at))
                    below += at
        left = []
        for x in todo:
            i = number[(x.group, x.low, x.high)]
            if i in fetched:
                found[x.group][x.rank] = float(fetched[i][x.rank - x.below])
                continue
            step = _narrowed(x, marks[i])
            if isinstance(step, Interval):
                left.append(step)
            else:
                found[x.group][x.rank] = step
        todo = left
    return found
