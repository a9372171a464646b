"""Shards of nearly equal bytes by a minimax contiguous partition.

Texts are ordered by a hash of their content. The atoms are the ``CELLS`` equal ranges of
that order; equal texts share a hash, so a group of copies always lies whole in one atom. Over the ordered atom
sizes a binary search finds the smallest capacity for which cutting greedily needs no more
than the wanted number of shards. An atom above the mean size (a hot group of copies) would set it for all; it
gets a shard of its own, and the rest is cut by the same search over the shards left, at no larger capacity.

What the driver sees is one size per atom, 65,536 numbers at any scale; at 100 TB an atom
is 1/1600 of a shard. Rows are numbered inside shards by salted parts of bounded size, so a group of copies
that holds a third of the table is numbered by many tasks. Texts are never shuffled.

Defined cases: a null text has no bytes (size ``ROW_BYTES``) and shares the atom of the
empty text; fewer atoms than shards leave the last shards empty; an empty table gives an empty
result. Repeated rows get a slot each.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.llm.common import ROWS_PER_SALT, text_or_empty
from credence.session import stage

SHARDS = 40
ROW_BYTES = 16
CELLS = 65_536


def greedy_cuts(ends: list[int], capacity: int, at: int, stop: int) -> list[int]:
    """Ends (exclusive) of the shards that hold the atoms ``at`` to ``stop``, filled greedily up to ``capacity``.

    ``ends`` are running totals of the atom sizes; no atom there is above the capacity.
    """
    cuts, done = [], ends[at - 1] if at else 0
    while at < stop:
        at = bisect_right(ends, done + capacity, lo=at, hi=stop)
        cuts.append(at)
        done = ends[at - 1]
    return cuts


def cuts_around(ends: list[int], alone: list[int], capacity: int) -> list[int]:
    """Cuts of the partition in which the atoms ``alone`` have a shard each and the stretches between are filled greedily."""
    cuts, at = [], 0
    for x in alone:
        cuts += [*greedy_cuts(ends, capacity, at, x), x + 1]
        at = x + 1
    return cuts + greedy_cuts(ends, capacity, at, len(ends))


def least_capacity(sizes: list[int], ends: list[int], alone: list[int], shards: int) -> int:
    """Smallest capacity of the other shards; that of the largest stretch is enough."""
    apart = set(alone)
    low, high = max((s for k, s in enumerate(sizes) if k not in apart), default=0), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if len(cuts_around(ends, alone, middle)) > shards:
            low = middle + 1
        else:
            high = middle
    return low


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """Cuts of a contiguous partition whose largest part is smallest, and that leaves no shard empty while atoms can be parted.

    An atom above the mean would set the capacity for all. It gets a shard of its own, where that needs no larger
    capacity, and the rest is partitioned over the shards left by the same search.
    """
    if not sizes:
        return []
    ends, alone = list(accumulate(sizes)), []
    capacity, rest = least_capacity(sizes, ends, [], shards), ends[-1]
    for x in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        if len(alone) == shards or sizes[x] * (shards - len(alone)) <= rest:
            break
        tried = sorted([*alone, x])
        if len(cuts_around(ends, tried, capacity)) <= shards:
            alone, rest = tried, rest - sizes[x]
    cuts = cuts_around(ends, alone, least_capacity(sizes, ends, alone, shards))
    while len(cuts) < min(shards, len(sizes)):  # what is left over halves the largest part of several atoms
        parts = [(a, b) for a, b in zip([0, *cuts], cuts) if b - a > 1]
        held = lambda a, b: ends[b - 1] - (ends[a - 1] if a else 0)
        a, b = max(parts, key=lambda p: held(*p))
        at = bisect_right(ends, (ends[a - 1] if a else 0) + held(a, b) // 2, lo=a, hi=b)
        cuts.append(min((k for k in (at, at + 1) if a < k < b), key=lambda k: max(held(a, k), held(k, b))))
        cuts.sort()
    return cuts


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = text_or_empty(text_col)
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(CELLS)).cast("int").alias("cell"),
    )
    narrow = stage(keyed, "shard-rows")
    cells = stage(narrow.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-cells")
    atoms = sorted((r["cell"], r["bytes"]) for r in cells.collect())  # at most CELLS
    cuts = minimax_cuts([size for _, size in atoms], shards)
    last = [atoms[c - 1][0] for c in cuts[:-1]]  # last cell of each shard but the final one
    bounds = F.array(*[F.lit(x) for x in last]) if last else F.array().cast("array<int>")
    number = lambda cell: F.size(F.filter(bounds, lambda x: x < cell))

    # slots: shard > cell > salted part > row
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    cells = cells.withColumn("shard", number(F.col("cell"))).select(
        "cell", "shard", F.ceil(F.col("n") / ROWS_PER_SALT).alias("parts"),
        zero(F.sum("n").over(before("shard").orderBy("cell"))).alias("cell_start"),
    )
    salted = narrow.join(F.broadcast(cells), "cell").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    parts = salted.groupBy("cell", "salt").agg(F.count("*").alias("n"), F.min("cell_start").alias("cell_start"))
    parts = parts.select(
        F.col("cell").alias("p_cell"), F.col("salt").alias("p_salt"),
        (F.col("cell_start") + zero(F.sum("n").over(before("cell").orderBy("salt")))).alias("start"),
    )
    inside = Window.partitionBy("cell", "salt").orderBy("doc_id", "text_crc32")
    numbered = salted.withColumn("r", F.row_number().over(inside) - 1)
    return numbered.join(parts, (F.col("cell") == F.col("p_cell")) & (F.col("salt") == F.col("p_salt"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("r")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
