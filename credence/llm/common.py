"""Helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from credence.session import stage

#: Rows of one hot group that share a window before the group is split further.
ROWS_PER_SALT = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What names a document: its id and a digest of its text.

    Rows equal in both are one document and get the same result, so no row number
    (which a re-run after a lost executor might deal out differently) is needed.
    """
    return [F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_th")]


def same_key(left: DataFrame, right: DataFrame) -> Column:
    return left["_id"].eqNullSafe(right["_id"]) & (left["_th"] == right["_th"])


def gapless_rank(rows: DataFrame, group: str, order: list[str], name: str = "_rank") -> DataFrame:
    """Number the rows of each value of ``group`` from 0 without a gap.

    A group of any size is cut by a hash of the order columns into parts of about
    ``ROWS_PER_SALT`` rows, numbered apart and shifted by the sizes of the parts before.
    ``rows`` must be cheap to read twice (a staged, narrow table).
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    parts = sizes.select(
        F.col(group).alias("_g"), F.greatest(F.lit(1), F.ceil(F.col("_n") / ROWS_PER_SALT)).alias("_parts")
    )
    salted = rows.join(parts, rows[group].eqNullSafe(parts["_g"])).drop("_g")
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(*order), F.col("_parts"))).drop("_parts")
    ahead = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy(group, "_salt").agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        .select(F.col(group).alias("_g"), F.col("_salt").alias("_s"), "_start")
    )
    inside = Window.partitionBy(group, "_salt").orderBy(*order)
    numbered = salted.withColumn("_r", F.row_number().over(inside) - 1)
    return (
        numbered.join(starts, numbered[group].eqNullSafe(starts["_g"]) & (numbered["_salt"] == starts["_s"]))
        .withColumn(name, (F.col("_r") + F.col("_start")).cast("long"))
        .drop("_r", "_start", "_g", "_s", "_salt")
    )


def next_in_order(rows: DataFrame, key: str, name: str = "_next") -> DataFrame:
    """(key, next): the key that follows in the order of the distinct keys; the last gets the one before, a single one nothing.

    Keys of any type that has an order are dealt into ranges, and each range is numbered in its own task; what follows the last
    key of a range comes from a table with one row a range.
    """
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct()
    dealt = stage(keys.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "ordered-keys")
    edges = dealt.groupBy("_part").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    by_part = Window.orderBy("_part")  # as many rows as there are ranges
    edges = edges.select(
        F.col("_part").alias("_edge"), F.lead("_first").over(by_part).alias("_ahead"), F.lag("_last").over(by_part).alias("_behind")
    )
    inside = Window.partitionBy("_part").orderBy(key)
    found = dealt.select(key, "_part", F.lead(key).over(inside).alias("_in"), F.lag(key).over(inside).alias("_before"))
    found = found.join(F.broadcast(edges), F.col("_part") == F.col("_edge"))
    return found.select(key, F.coalesce("_in", "_ahead", "_before", "_behind").alias(name)).where(F.col(name).isNotNull())


def connected(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) with the smallest node reachable over ``links`` (a, b); linked nodes only.

    Labels spread to neighbours and roots until none changes; every round is one
    shuffled join over a staged table, nothing comes to the driver but a count.
    """
    both = stage(
        links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct(), f"{name}-edges"
    )
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        offered = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("_n")).agg(F.min("root").alias("_o"))
        hop = (
            labels.join(offered, labels["node"] == offered["_n"], "left")
            .select("node", F.col("root").alias("old"), F.least("root", F.coalesce("_o", "root")).alias("root"))
        )
        up = labels.select(F.col("node").alias("_m"), F.col("root").alias("_up"))
        hop = hop.join(up, hop["root"] == up["_m"], "left").select(
            "node", "old", F.least("root", F.coalesce("_up", "root")).alias("root")
        )
        hop = stage(hop, f"{name}-{step}")
        labels = hop.select("node", "root")
        if hop.where("old <> root").isEmpty():
            return labels


def fixed_width(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


LONG, STRING = T.LongType(), T.StringType()
