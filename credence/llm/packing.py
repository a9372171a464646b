"""Packing of tokenised documents into sequences by minimum bin slack.

Every document becomes pieces of at most ``capacity`` tokens. The numbers of pieces of
each length are counted; over that histogram (at most ``capacity`` numbers, whatever the
corpus) bins are built one after the other: the longest length left starts a bin, and a
bitset subset-sum over the other lengths left finds the fullest feasible combination, which is removed,
as many times over as the histogram allows. The plan, a list of combinations with their
repetitions, then deals pieces out by their rank among the pieces of their length, a join
that Spark runs over all pieces at once.

Texts are tokenised once, in Arrow batches; what is shuffled is one narrow row a piece.

Defined cases: null text is empty; an empty document is one piece holding only the end
token. Equal lengths are interchangeable, so ties and repeated rows need no order. An
empty table gives no piece. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.arrays import part_slices
from credence.llm.common import gapless_rank
from credence.llm.wordpieces import WordPieces
from credence.session import stage

CAPACITY = 2048
END = 0
#: Characters of text that a task tokenises at a time, for more than one text; an array operation holds some 30 bytes for each.
SLICE = 500_000
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenise(vocabulary: str, capacity: int = CAPACITY):
    """A mapInArrow function from (doc_id, text) to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of, end, width = WordPieces(vocabulary), END.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            before = b""  # ids of the parts of a text that went before
            for marks, parts in part_slices(texts, SLICE):
                ids, counts = pieces_of.batch(parts)
                owner, rows, stop = [], [], 0
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                for (k, last), count in zip(marks, counts.tolist(), strict=True):
                    before += raw[stop : stop + 4 * count]
                    stop += 4 * count
                    if not last:
                        continue
                    whole, before = before + end, b""
                    for piece, byte in enumerate(range(0, len(whole), width)):
                        cut = whole[byte : byte + width]
                        owner.append(k)
                        rows.append((piece, byte // 4, len(cut) // 4, zlib.crc32(cut)))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *columns], NAMES)

    return run


def fullest(lengths: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The combination of (length, count available) with the largest total up to ``room``, as (length, uses).

    ``reach[k]`` is a bitset of the totals the first k lengths can make; tracing back prefers
    to leave later (shorter) lengths unused.
    """
    mask = (1 << (room + 1)) - 1
    reach = [1]
    used: list[tuple[int, int]] = []
    full = 1 << room
    for length, count in lengths:
        bits, copies, chunk = reach[-1], min(count, room // length), 1
        while copies > 0:  # copies in doubling bundles
            take = min(chunk, copies)
            bits |= (bits << (take * length)) & mask
            copies -= take
            chunk *= 2
        reach.append(bits)
        used.append((length, count))
        if bits & full:
            break
    total = reach[-1].bit_length() - 1
    chosen = []
    for k in range(len(used), 0, -1):
        length, count = used[k - 1]
        uses = 0
        while not (reach[k - 1] >> total) & 1:
            total -= length
            uses += 1
        if uses:
            chosen.append((length, uses))
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repetitions, [(length, uses), ...]) of all bins; removes everything in the histogram."""
    left = {length: n for length, n in histogram.items() if n}
    order = sorted(left, reverse=True)
    bins = []
    while order:
        first = order[0]
        left[first] -= 1
        chosen = dict(fullest([(x, left[x]) for x in order if left[x] and x <= capacity - first], capacity - first))
        left[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        times = min(left[x] // uses for x, uses in chosen.items())
        for x, uses in chosen.items():
            left[x] -= times * uses
        bins.append((times, sorted(chosen.items(), reverse=True)))
        order = [x for x in order if left[x]]
    return bins


def plan_rows(bins) -> list[tuple]:
    """(length, from, to, uses, sequence, offset): ranks of a length from..to go to bins from ``sequence`` on."""
    rows, taken, sequence = [], {}, 0
    for times, parts in bins:
        offset = 0
        for length, uses in parts:
            start = taken.get(length, 0)
            taken[length] = start + times * uses
            rows.append((length, start, taken[length], uses, sequence, offset))
            offset += length * uses
        sequence += times
    return rows


def pieces(docs: DataFrame, id_col="doc_id", text_col="text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = PIECES.format(id=plain.schema["doc_id"].dataType.simpleString())
    return plain.mapInArrow(tokenise(vocabulary or default_vocabulary(), capacity), schema)


def pack(docs: DataFrame, id_col="doc_id", text_col="text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, id_col, text_col, vocabulary, capacity), "token-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity
    rows = plan_rows(plan_bins(histogram, capacity))
    # a few thousand rows: bounded by the lengths, not by the pieces
    plan = spark.createDataFrame(rows, "p_length long, p_from long, p_to long, uses long, first long, at long")
    ranked = gapless_rank(cut, "length", ["doc_id", "piece", "ids_crc32"])
    place = (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("p_from")) & (F.col("_rank") < F.col("p_to"))
    nth = F.col("_rank") - F.col("p_from")
    return ranked.join(F.broadcast(plan), place).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("uses"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("uses")) * F.col("length")).cast("long").alias("offset"),
    )
