"""Exact, deterministic train/validation/test splits without sorting the data.

Rows are ranked inside a class by ``md5(id:seed)``. The set taken from a class is
"every hash up to the k-th smallest", so a split is fully described by one
threshold hash per class and cut. Thresholds come from a histogram of hash
prefixes (one aggregation, a fixed number of result rows) and from the rows of
the few histogram cells a threshold falls into; tagging is then row-local.
Ids are unique after de-duplication. Where a repeated id sits on a threshold, no cut by ids has the wanted size; then
the rows themselves are ordered, by id, digest of the row and, among equal rows, their number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from credence.functions.text import is_blank
from credence.schema import require_columns
from credence.session import stage

PREFIX_HEX_DIGITS = 4  # 65,536 histogram cells per class
ROW_KEY = "_row_key"


class RepeatedId(ValueError):
    """A cut would have to fall between rows of one id."""


@dataclass(frozen=True)
class SplitPlan:
    """Ordered cuts: ``(split name, {class or None: highest hash taken})``."""

    id_column: str
    label_column: str
    seed: int
    cuts: list
    rest: str
    sizes: dict

    def column(self) -> Column:
        key = order_hash(self.id_column, self.seed)
        tag = None
        for name, thresholds in self.cuts:
            taken = F.lit(False)
            for stratum, last in thresholds.items():
                inside = key <= last
                if stratum is not None:
                    inside = inside & (F.col(self.label_column) == stratum)
                taken = taken | inside
            tag = F.when(taken, name) if tag is None else tag.when(taken, name)
        return tag.otherwise(self.rest)

    def apply(self, df: DataFrame, column="split") -> DataFrame:
        return df.withColumn(column, self.column())


def order_hash(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")))


def class_quotas(counts: dict, n_draw: int) -> dict:
    """Share ``n_draw`` over classes by floor and largest remainder; a tie in the
    remainder goes to the smaller label."""
    total = sum(counts.values())
    exact = {c: k / total * n_draw for c, k in counts.items()}
    quota = {c: math.floor(x) for c, x in exact.items()}
    short = n_draw - sum(quota.values())
    by_remainder = sorted(counts, key=lambda c: (-(exact[c] - quota[c]), c))
    for c in by_remainder[:short]:
        quota[c] += 1
    return quota


def held_out_quotas(counts: dict, n_held_out: int) -> dict:
    """Class quotas of the held-out side, allotted after the larger side."""
    n = sum(counts.values())
    larger = class_quotas(counts, n - n_held_out)
    return class_quotas({c: counts[c] - larger[c] for c in counts}, n_held_out)


def _check_sizes(n: int, n_out: int, n_classes: int) -> None:
    if n - n_out < max(n_classes, 1) or n_out < max(n_classes, 1):
        raise ValueError(f"cannot take {n_out} of {n} rows for {n_classes} classes")


class _HashOrder:
    """Histogram of hash prefixes per class over ``(_label, _hash)`` rows."""

    def __init__(self, keys: DataFrame):
        self.keys = keys.withColumn(
            "_cell", F.conv(F.substring("_hash", 1, PREFIX_HEX_DIGITS), 16, 10).cast("int")
        )
        rows = self.keys.groupBy("_label", "_cell").count().collect()
        self.cells: dict = {}
        for r in rows:
            self.cells.setdefault(r["_label"], {})[r["_cell"]] = r["count"]

    def counts(self) -> dict:
        return {label: sum(c.values()) for label, c in sorted(self.cells.items())}

    def thresholds(self, positions: dict) -> dict:
        """``{(stratum, k): k-th smallest hash}``; stratum ``None`` is all rows."""
        wanted = []
        for stratum, ks in positions.items():
            labels = list(self.cells) if stratum is None else [stratum]
            merged: dict = {}
            for label in labels:
                for cell, n in self.cells[label].items():
                    merged[cell] = merged.get(cell, 0) + n
            for k in ks:
                before = 0
                for cell in sorted(merged):
                    if before + merged[cell] >= k:
                        wanted.append((stratum, k, cell, k - before))
                        break
                    before += merged[cell]
        if not wanted:
            return {}
        by_class = None not in positions
        group = ["_label", "_cell"] if by_class else ["_cell"]
        in_cells = F.lit(False)
        at_offset = F.lit(False)
        for stratum, _, cell, offset in wanted:
            here = F.col("_cell") == cell
            if by_class:
                here = here & (F.col("_label") == stratum)
            in_cells = in_cells | here
            at_offset = at_offset | (here & (F.col("_rank") == offset))
        window = Window.partitionBy(*group).orderBy("_hash")
        ranked = self.keys.where(in_cells).withColumns(
            {"_rank": F.row_number().over(window), "_next": F.lead("_hash").over(window)}
        )
        at_cut = ranked.where(at_offset).collect()
        if any(r["_hash"] == r["_next"] for r in at_cut):
            raise RepeatedId("a repeated id stands where a cut has to fall; make the ids unique first")
        found = {
            (r["_label"] if by_class else None, r["_cell"], r["_rank"]): r["_hash"] for r in at_cut
        }
        return {(s, k): found[(s, cell, offset)] for s, k, cell, offset in wanted}


def with_row_keys(df: DataFrame, id_column: str) -> DataFrame:
    """Adds ``ROW_KEY``, different for every row and the same set of keys on every run.

    Rows that equal others in all columns are numbered: each task numbers those of its part, and the sizes of the
    parts before shift them, so that a row copied any number of times is no single task's work.
    """
    columns = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    named = df.withColumn("_digest", F.concat_ws("|", F.col(id_column).cast("string"), F.md5(columns)))
    named = stage(named.withColumn("_part", F.spark_partition_id()), "rows-to-split")
    sizes = named.groupBy("_digest", "_part").agg(F.count("*").alias("_n"))
    # where no row repeats, nothing is numbered
    if sizes.groupBy("_digest").agg(F.sum("_n").alias("_n")).where("_n > 1").isEmpty():
        return named.withColumn(ROW_KEY, F.col("_digest")).drop("_digest", "_part")
    before = Window.partitionBy("_digest").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_digest", "_part").orderBy("_digest")
    numbered = named.withColumn("_place", F.row_number().over(inside)).join(starts, ["_digest", "_part"])
    key = F.concat_ws("|", "_digest", (F.col("_place") + F.col("_start")).cast("string"))
    return stage(numbered.withColumn(ROW_KEY, key).drop("_digest", "_part", "_place", "_start"), "numbered-rows")


def _plan(df, id_column, label_column, seed, sizes, can_stratify) -> SplitPlan:
    """``sizes`` is ``[(name, share of what is left)]``; the rest is training."""

    def order_of(rows):
        return _HashOrder(
            rows.select(
                F.col(label_column).alias("_label"), order_hash(id_column, seed).alias("_hash")
            )
        )

    def not_yet_cut():
        so_far = SplitPlan(id_column, label_column, seed, cuts, "", {})
        return order_of(df.where(so_far.column() == ""))

    cuts, held_out = [], {}
    order = order_of(df)
    taken = dict.fromkeys(order.cells, 0)
    for name, share in sizes:
        left = {c: k - taken[c] for c, k in order.counts().items()}
        n = sum(left.values())
        n_out = math.ceil(share * n)
        stratify = n > 0 and can_stratify(left)
        _check_sizes(n, n_out, len(left) if stratify else 1)
        if stratify:
            quotas = held_out_quotas(left, n_out)
            found = order.thresholds({c: [taken[c] + q] for c, q in quotas.items() if q})
            taken = {c: taken[c] + quotas[c] for c in taken}
        else:
            if any(taken.values()):
                order = not_yet_cut()
            found = order.thresholds({None: [n_out]})
        cuts.append((name, {stratum: h for (stratum, _), h in found.items()}))
        held_out[name] = n_out
        if not stratify:
            # this cut mixed the classes, so the next one counts afresh
            order = not_yet_cut()
            taken = dict.fromkeys(order.cells, 0)
    rows_left = sum(order.counts().values()) - sum(taken.values())
    return SplitPlan(id_column, label_column, seed, cuts, "train", {**held_out, "train": rows_left})


def fit_split(
    df: DataFrame, val_size=0.15, test_size=0.15, seed=42, *, id_column="id", label_column="label"
) -> SplitPlan:
    """70/15/15 by default; a cut is stratified when there is more than one class
    and the smallest has at least three rows. Reads ``df`` twice (narrow). The plan tags any frame with these
    ids, so an id on a cut must stand in one row; ``split_dataset`` also splits the rows of an id."""
    sizes = [("test", test_size), ("val", val_size / (1 - test_size))]
    return _plan(
        df, id_column, label_column, seed, sizes,
        lambda counts: len(counts) > 1 and min(counts.values()) >= 3,
    )


def split_dataset(df: DataFrame, val_size=0.15, test_size=0.15, seed=42, **columns) -> DataFrame:
    """``fit_split`` applied to the same frame, whose ids may repeat."""
    try:
        return fit_split(df, val_size, test_size, seed, **columns).apply(df)
    except RepeatedId:
        rows = with_row_keys(df, columns.get("id_column", "id"))
        plan = fit_split(rows, val_size, test_size, seed, **{**columns, "id_column": ROW_KEY})
        return plan.apply(rows).drop(ROW_KEY)


def contract_checks(df: DataFrame, text_column: str, label_column: str) -> DataFrame:
    """Counts that decide whether a table can be split, in one aggregation."""
    text, label = F.col(text_column), F.col(label_column)
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(text.isNull()).alias("null_text"),
        F.count_if(label.isNull()).alias("null_label"),
        F.count_if(is_blank(text)).alias("blank_text"),
        F.count_distinct(label).alias("label_values"),
    )


def split_labeled_data(
    df: DataFrame,
    *,
    text_column: str,
    label_column: str,
    id_column="id",
    test_size=0.20,
    validation_size=0.20,
    random_state=42,
) -> DataFrame:
    """Strictly stratified 60/20/20 by default; adds ``split``.

    Raises when the contract is broken or a class cannot be spread over all three
    parts. A part is ``where("split = 'train'")``.
    """
    if len({text_column, label_column, id_column}) < 3:
        raise ValueError(f"one column named twice among {[id_column, text_column, label_column]}")
    require_columns(df, [text_column, label_column, id_column])
    shares = {"train": 1 - test_size - validation_size, "validation": validation_size, "test": test_size}
    if min(shares.values()) <= 0:
        raise ValueError(f"every part needs a share above 0: {shares}")
    counted = contract_checks(df, text_column, label_column).first().asDict()
    broken = {k: v for k, v in counted.items() if k.startswith(("null_", "blank_")) and v}
    if counted["label_values"] != 2:
        broken["label_values"] = counted["label_values"]
    if broken:
        raise ValueError(f"the table breaks the split contract in {sorted(broken)}; counted {counted}")

    def strict(counts):
        if min(counts.values()) < 2:
            raise ValueError(f"cannot stratify classes of size {counts}")
        return True

    sizes = [("test", test_size), ("validation", validation_size / (1 - test_size))]
    try:
        plan = _plan(df, id_column, label_column, random_state, sizes, strict)
    except RepeatedId:
        df = with_row_keys(df, id_column)
        plan = _plan(df, ROW_KEY, label_column, random_state, sizes, strict)
    for name, thresholds in plan.cuts:
        if len(thresholds) < 2:
            raise ValueError(f"{name} would hold {len(thresholds)} of 2 classes, with cuts {plan.sizes}")
    return plan.apply(df).drop(ROW_KEY)
