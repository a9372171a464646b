"""Removal of repeated strings by a column-wise multi-document suffix construction.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else goes, in all its occurrences.

1. *Anchors.* Each ``LENGTH``-byte window has a minimizer: of its ``GRAM``-byte grams the one with the smallest hash,
   leftmost on a tie. Equal windows have equal minimizers at equal places, so all occurrences of a repeated window meet at one
   anchor hash. Neighbouring windows mostly share an anchor; its *context* is all the bytes of the windows that do, at most
   ``2 * LENGTH - GRAM`` of them. Contexts travel as digests; equal ones repeat as a whole and are settled by counting.
2. *Columns.* Different contexts of one anchor are lined up on it and taken together as a collection of documents. The construction goes column by
   column from the right: each round puts one symbol before the suffix of every document, which re-sorts the collection by
   that symbol, stably (the Burrows-Wheeler step), and updates the common prefixes of neighbours in the order. Where a common prefix reaches
   ``LENGTH``, both neighbours' windows at that column are repeated. The rounds are bounded by the length of a context, whatever
   the length of a document; the collections come sequentially from the sorted shuffle files of a task, a bounded number of contexts at a time.
3. *Crowds.* An anchor with more than ``COLLECTION`` different contexts is no collection. The windows that start in a block of ``BLOCK``
   neighbouring columns have all bytes but the outermost in common; so the digests of these cores are counted for each anchor and
   block, and where a core repeats, so are the digests of the single windows. Both are counts with partial sums in each map task:
   no task holds the crowd.
4. *Spans.* Repeated windows go back to all documents that hold their context, and merge there into removed runs.

What is compared are bytes; hashes only say what to compare, but for whole equal contexts and the windows of crowds (a 128-bit digest).

Defined cases: null text counts as empty; texts under ``LENGTH`` bytes keep everything. Rows equal in id and text are each
an occurrence, so their windows are repeated. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.arrays import RunHashes, mixed
from credence.llm.common import let, row_key, text_or_empty
from credence.session import stage

LENGTH = 400
GRAM = 64
#: Contexts that a task takes together, with those of the last anchor less than twice as many; an anchor with more is a crowd.
COLLECTION = 16_000
#: Columns of a crowd whose windows are first counted together.
BLOCK = 32
ABSENT = 256
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, in a constant number of steps a key."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.hashes = length, gram, RunHashes()

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash and place of each anchor, and its first and last window start."""
        if len(data) < self.length:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        at = np.arange(len(data) - self.gram + 1)
        grams = mixed(self.hashes(values, at, at + self.gram))
        least = sliding_least((grams & _HIGH) | at.astype(np.uint64), self.length - self.gram + 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.concatenate((first[1:], [len(least)])) - 1
        place = (least[first] & _LOW).astype(np.int64)
        return grams[place].view(np.int64), place, first, last


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _th, data) to one row an anchor: (anchor, digest, _id, _th, first, size, at)."""
    anchors = Anchors()
    for batch in batches:
        rows, hashes, digests, firsts, sizes, places = [], [], [], [], [], []
        for k, data in enumerate(batch.column(2)):
            data = data.as_py() or b""
            h, place, first, last = anchors.of(data)
            if not len(h):
                continue
            ends = last + LENGTH
            off = place - first
            rows.append(np.full(len(h), k))
            hashes.append(h)
            firsts.append(first)
            sizes.append(ends - first)
            places.append(off)
            digests += [
                hashlib.blake2b(data[a:b], digest_size=16, key=b"%d" % o).digest()
                for a, b, o in zip(first.tolist(), ends.tolist(), off.tolist(), strict=True)
            ]
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        row = pa.array(join(rows))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(join(hashes)), pa.array(digests, pa.binary()), batch.column(0).take(row), batch.column(1).take(row),
                pa.array(join(firsts)), pa.array(join(sizes).astype(np.int32)), pa.array(join(places).astype(np.int32)),
            ],
            ["anchor", "digest", "_id", "_th", "first", "size", "at"],
        )


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(data, places) to (anchor, digest, at, context)."""
    for batch in batches:
        out: list[tuple] = []
        for data, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            data = data.as_py()
            out += [(p["anchor"], p["digest"], p["at"], data[p["first"] : p["first"] + p["size"]]) for p in places]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["anchor", "digest", "at", "context"]
        )


def repeated_windows(contexts: list[bytes], at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each context (a row) and column, whether its window there is also a window of another at that column.

    Column ``length - gram`` is the anchor's. One symbol per document and round, from the right.
    """
    reach, width = length - gram, 2 * length - gram
    n = len(contexts)
    table = np.full((n, width), ABSENT, np.uint16)
    for k, (context, a) in enumerate(zip(contexts, at.tolist(), strict=True)):
        table[k, reach - a : reach - a + len(context)] = np.frombuffer(context, np.uint8)
    columns = np.ascontiguousarray(table.T)
    order = np.arange(n)  # documents by their present suffix
    common = np.zeros(n + 1, np.int16)  # with the one before in the order; one more for the last range
    found = np.zeros((reach + 1, n), bool)
    for c in range(width - 1, -1, -1):
        symbols = columns[c][order]
        move = np.argsort(symbols, kind="stable")
        symbols, order = symbols[move], order[move]
        before, after = move[:-1], move[1:]
        same = (symbols[1:] == symbols[:-1]) & (symbols[1:] != ABSENT)
        shared = common[after]
        far = np.flatnonzero(same & (after != before + 1))
        if len(far):  # the least common prefix of all that stood between the two
            ranges = np.empty(2 * len(far), np.int64)
            ranges[0::2], ranges[1::2] = before[far] + 1, after[far] + 1
            shared[far] = np.minimum.reduceat(common, ranges)[::2]
        common = np.zeros(n + 1, np.int16)
        common[1:n] = np.where(same, np.minimum(shared + 1, length), 0)
        if c <= reach:
            hit = common[1:n] >= length
            found[c, order[1:][hit]] = True
            found[c, order[:-1][hit]] = True
    return found.T


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor to (anchor, digest, lo, hi): runs of repeated window starts, from the context's start."""
    names = ["anchor", "digest", "lo", "hi"]

    def collection(rows: list[tuple]) -> pa.RecordBatch:
        at = np.array([r[2] for r in rows])
        found = repeated_windows([r[3] for r in rows], at)
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, lo = np.nonzero(edge == 1)
        _, hi = np.nonzero(edge == -1)
        shift = at[row] - (LENGTH - GRAM)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][0] for k in row], pa.int64()), pa.array([rows[k][1] for k in row], pa.binary()),
                pa.array((lo + shift).astype(np.int32)), pa.array((hi - 1 + shift).astype(np.int32)),
            ],
            names,
        )

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if len(held) >= COLLECTION and held[-1][0] != row[0]:
                yield collection(held)
                held = []
            held.append(row)
    if held:
        yield collection(held)


def cores(block: int):
    """A mapInArrow function from (anchor, digest, at, context, columns) to (anchor, digest, column, core): for each block of columns the
    digest of the bytes that all its windows hold. ``columns`` are the first ones of the ``BLOCK``s to look into; null stands for all."""
    reach = LENGTH - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for anchor, digest, at, context, columns in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                start = reach - at
                low, high = start, start + len(context) - LENGTH  # first and last window
                for a in range(0, reach + 1, BLOCK) if columns is None else columns:
                    b = min(a + BLOCK - 1, reach)
                    for c in range(a, b + 1, block):
                        d = min(c + block - 1, b)
                        if c <= high and d >= low:
                            core = context[d - start : c - start + LENGTH]
                            out.append((anchor, digest, c, hashlib.blake2b(core, digest_size=16).digest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["anchor", "digest", "column", "core"]
            )

    return run


def column_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, digest, at, columns) to (anchor, digest, lo, hi), as of ``compare``."""
    for batch in batches:
        out: list[tuple] = []
        for anchor, digest, at, columns in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            found = np.sort(np.array(columns)) + at - (LENGTH - GRAM)
            gap = np.flatnonzero(np.diff(found) > 1)
            lows, highs = found[np.concatenate(([0], gap + 1))], found[np.concatenate((gap, [len(found) - 1]))]
            out += [(anchor, digest, lo, hi) for lo, hi in zip(lows.tolist(), highs.tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["anchor", "digest", "lo", "hi"])


def crowd_runs(contexts: DataFrame) -> DataFrame:
    """What ``compare`` gives, for staged contexts of crowded anchors, by counting (step 3)."""
    all_ = F.lit(None).cast("array<int>")
    asked = contexts.select("anchor", "digest", "at", "context", all_.alias("columns"))
    for block in (BLOCK, 1):
        dealt = stage(asked.mapInArrow(cores(block), "anchor long, digest binary, column int, core binary"), f"cores-{block}")
        key = ["anchor", "column", "core"]
        again = dealt.join(dealt.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), key)
        columns = again.groupBy("anchor", "digest").agg(F.collect_list("column").alias("columns"))  # at most one a column
        asked = contexts.join(columns, ["anchor", "digest"]).select("anchor", "digest", "at", "context", "columns")
    return asked.select("anchor", "digest", "at", "columns").mapInArrow(column_runs, "anchor long, digest binary, lo int, hi int")


def contexts_of(data: DataFrame, distinct: DataFrame) -> DataFrame:
    """(anchor, digest, at, context) of different contexts, each cut from one text that holds it."""
    places = distinct.groupBy(F.col("p._id").alias("p_id"), F.col("p._th").alias("p_th")).agg(
        F.collect_list(F.struct("anchor", "digest", F.col("p.first").alias("first"), "size", F.col("p.at").alias("at"))).alias("places")
    )
    texts = data.join(places, data["_id"].eqNullSafe(places["p_id"]) & (data["_th"] == places["p_th"]))
    return texts.select("data", "places").mapInArrow(cut_contexts, "anchor long, digest binary, at int, context binary")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, spans): byte runs (a, b) of each document that repeated windows cover, not yet merged."""
    data = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).cast("binary").alias("data"))
    kind = data.schema["_id"].dataType.simpleString()
    every = stage(
        data.mapInArrow(find_anchors, f"anchor long, digest binary, _id {kind}, _th long, first long, size int, at int"), "anchors"
    )
    # staged, so that the join deals rows out anew and can split an anchor that very many places share
    often = stage(
        every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("digest").alias("d1"), F.max("digest").alias("d2"))
        .where("n > 1").select("anchor", (F.col("d1") != F.col("d2")).alias("differ")),
        "frequent-anchors",
    )
    again = stage(every.join(often, "anchor"), "repeated-anchors")
    distinct = stage(
        again.groupBy("anchor", "digest").agg(
            F.count("*").alias("n"), F.max("differ").alias("differ"), F.max("size").alias("size"),
            F.min(F.struct("_id", "_th", "first", "at")).alias("p"),
        ),
        "contexts",
    )
    whole = distinct.where("n > 1").select("anchor", "digest", F.lit(0).alias("lo"), (F.col("size") - LENGTH).alias("hi"))
    differ = distinct.where("differ")
    crowded = stage(
        differ.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > COLLECTION).select("anchor"), "crowded-anchors"
    )
    crowds = not crowded.isEmpty()
    contexts = contexts_of(data, differ.join(crowded, "anchor", "left_anti") if crowds else differ)
    sorted_ = contexts.repartition("anchor").sortWithinPartitions("anchor")
    partly = stage(sorted_.mapInArrow(compare, "anchor long, digest binary, lo int, hi int"), "repeated-windows")
    if crowds:
        contexts = stage(contexts_of(data, differ.join(crowded, "anchor", "left_semi")), "crowded-contexts")
        partly = partly.unionByName(stage(crowd_runs(contexts), "repeated-crowd-windows"))
    runs = whole.unionByName(partly).select(F.col("anchor").alias("r_anchor"), F.col("digest").alias("r_digest"), "lo", "hi")
    hit = again.join(runs, (F.col("anchor") == F.col("r_anchor")) & (F.col("digest") == F.col("r_digest")))
    span = F.struct((F.col("first") + F.col("lo")).alias("a"), (F.col("first") + F.col("hi") + LENGTH).alias("b"))
    return hit.select("_id", "_th", span.alias("span")).groupBy("_id", "_th").agg(F.collect_set("span").alias("spans"))


def merged(spans: Column) -> Column:
    """Ordered, disjoint spans; touching ones become one."""
    kind = "array<struct<a:bigint,b:bigint>>"

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        wider = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))),
        )
        return F.when((F.size(done) > 0) & (last["b"] >= x["a"]), wider.cast(kind)).otherwise(
            F.concat(done, F.array(x)).cast(kind)
        )

    return F.aggregate(F.sort_array(spans).cast(kind), F.array().cast(kind), add)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as struct ``row`` with ``spans`` (removed byte runs), ``n_bytes`` and ``kept`` (binary)."""
    runs = repeated_runs(docs, id_col, text_col).select(
        F.col("_id").alias("r_id"), F.col("_th").alias("r_th"), let(F.col("spans"), merged).alias("spans")
    )
    rows = docs.select(F.struct("*").alias("row"), *row_key(id_col, text_col))
    joined = rows.join(runs, rows["_id"].eqNullSafe(runs["r_id"]) & (rows["_th"] == runs["r_th"]), "left")
    data = text_or_empty(f"row.{text_col}").cast("binary")
    joined = joined.select(
        "row", data.alias("data"), F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("spans")
    )
    size = F.octet_length("data").cast("long")
    # what lies between the end of one removed run and the start of the next
    between = F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda i: F.struct(
            F.when(i > 0, F.get("spans", i - 1)["b"]).otherwise(F.lit(0)).alias("a"),
            F.when(i < F.size("spans"), F.get("spans", i)["a"]).otherwise(size).alias("b"),
        ),
    )
    part = lambda s: F.substring(F.col("data"), (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int"))
    kept = F.aggregate(between, F.lit("").cast("binary"), lambda done, s: F.concat(done, part(s)))
    return joined.select("row", "spans", size.alias("n_bytes"), kept.alias("kept"))


def report(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return done.select(
        F.col(f"row.{id_col}").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )
