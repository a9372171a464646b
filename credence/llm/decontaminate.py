"""Benchmark decontamination by a broadcast hash set of test n-grams.

Windows of ``n`` consecutive words of every test item (an item of fewer words is one
window) are hashed into an array of buckets, which is sent to the executors as the
value of a scalar subquery. Each text is then scanned in its own row: every word window
looks up one bucket, a hit is verified word by word, and hits of all lengths are merged
into covered positions. No document is shuffled, and nothing about documents is collected.

A set larger than ``MAX_INDEX_WINDOWS`` is cut into blocks by hash; the documents are scanned once a
block, so an executor never holds more than one bounded block.

Defined cases: null and empty texts have no words and no hits; null item texts give no
window. Windows of items without an id hit like any other, but no item is counted for them. Equal windows of several items are stored once with all their items. Repeated
documents get equal results. Empty tables give empty or clean results. Clashing extra
columns cannot interfere: the input row travels as one struct.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import let, text_or_empty
from credence.session import stage

WINDOW = 10
#: Windows that one broadcast block may hold (about 100 bytes each).
MAX_INDEX_WINDOWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower-cased, and before that.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NOT_WORD), "")


def _windows(words: Column, length: Column | int) -> Column:
    """All windows of ``length`` words, by start; empty where the text is shorter."""
    starts = F.sequence(F.lit(1), F.size(words) - length + 1)
    return F.when(F.size(words) < length, F.array().cast("array<array<string>>")).otherwise(
        F.transform(starts, lambda i: F.slice(words, i, length))
    )


def item_windows(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(w, h, items): each distinct window of the test set, its hash and its items."""
    worded = items.select(F.col(id_col).cast("string").alias("item"), words_of(text_or_empty(text_col)).alias("words"))
    worded = worded.where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(n))
    return (
        worded.select("item", F.explode(_windows(F.col("words"), length)).alias("w"))
        .groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("h", F.xxhash64("w"))
    )


def _buckets(windows: DataFrame, count: int) -> DataFrame:
    """One row: an array of ``count`` buckets, each an array of (h, w, items)."""
    filled = windows.groupBy(F.pmod("h", F.lit(count)).alias("b")).agg(
        F.collect_list(F.struct("h", "w", "items")).alias("entries")
    )
    every = windows.sparkSession.range(count).withColumnRenamed("id", "k")
    kind = dict(filled.dtypes)["entries"]
    return (
        every.join(filled, F.col("k") == F.col("b"), "left")
        .select("k", F.coalesce("entries", F.array().cast(kind)).alias("entries"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "entries"))), lambda x: x["entries"]).alias("buckets"))
    )


def _hits(words: Column, count: int, lengths: list[int], index: Column) -> Column:
    """(start, end, items) of every verified window of the text, by length then start."""

    def of_length(length: int) -> Column:
        bucket = lambda h: F.get(index, F.pmod(h, F.lit(count)).cast("int"))
        starts = F.sequence(F.lit(1), F.size(words) - length + 1)
        hashed = F.transform(starts, lambda i: F.struct(i.alias("a"), F.xxhash64(F.slice(words, i, length)).alias("h")))
        likely = F.filter(hashed, lambda x: F.exists(bucket(x["h"]), lambda e: e["h"] == x["h"]))

        def verified(x: Column) -> Column:
            same = F.filter(bucket(x["h"]), lambda e: (e["h"] == x["h"]) & (e["w"] == F.slice(words, x["a"], length)))
            return F.struct(x["a"].alias("a"), (x["a"] + length).alias("b"), F.get(same, 0)["items"].alias("items"))

        found = F.transform(likely, verified)
        return F.when(F.size(words) >= length, F.filter(found, lambda x: x["items"].isNotNull()))

    none = F.array().cast("array<struct<a:int,b:int,items:array<string>>>")
    return F.concat(none, *[F.coalesce(of_length(length), none) for length in lengths])


def _covered(hits: Column) -> Column:
    """Disjoint, ordered (a, b) spans of the hit words, ends exclusive."""
    spans = F.sort_array(F.transform(hits, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))
    kind = "array<struct<a:int,b:int>>"

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        wider = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))),
        )
        return F.when((F.size(done) > 0) & (last["b"] >= x["a"]), wider.cast(kind)).otherwise(
            F.concat(done, F.array(x)).cast(kind)
        )

    return F.aggregate(spans, F.array().cast(kind), add)


def scan(docs: DataFrame, items: DataFrame, text_col="text", item_id="item_id", item_text="text", n: int = WINDOW) -> DataFrame:
    """``docs`` as struct ``row`` with ``words``, ``spans`` (hit word positions from 1) and ``items``."""
    windows = stage(item_windows(items, item_id, item_text, n), "test-windows")
    total = windows.count()
    lengths = [r[0] for r in windows.select(F.size("w")).distinct().orderBy(F.size("w")).collect()]  # at most n
    blocks = max(1, -(-total // MAX_INDEX_WINDOWS))
    # Generating a single row keeps the optimiser from copying the split into its users.
    out = docs.select(F.struct("*").alias("row"), text_or_empty(text_col).alias("_t")).select(
        "row", F.explode(F.array(words_of(F.col("_t")))).alias("words")
    )
    out = out.withColumn("hits", F.array().cast("array<struct<a:int,b:int,items:array<string>>>"))
    for block in range(blocks if total else 0):
        part = windows.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == block)
        count = max(1, min(2 * total, MAX_INDEX_WINDOWS))
        # used once, so the optimiser puts the subquery's value in place of the column and no row carries it
        indexed = out.withColumn("index", _buckets(part, count).scalar())
        found = let(F.col("index"), partial(_hits, F.col("words"), count, lengths))
        out = indexed.select("row", "words", F.concat("hits", found).alias("hits"))
        if blocks > 1:
            out = stage(out, f"test-hits-{block}")
    return out.select(
        "row", "words", let(F.col("hits"), _covered).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"])))).alias("items"),
    )


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0), lambda a, x: a + x["b"] - x["a"])
    return scanned.select(
        F.col(f"row.{id_col}").alias("doc_id"),
        F.size("words").cast("long").alias("n_words"),
        n_hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """The input without the documents that hold a window of the test set."""
    return scan(docs, items, **names).where(F.size("spans") == 0).select("row.*")


def clean_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """The input with the hit words, and what stands before each of them, cut from the texts."""
    found = scan(docs, items, text_col=text_col, **names)
    text = F.col(f"row.{text_col}")

    def rebuilt(between: Column) -> Column:
        own = F.array_remove(F.split(text, NOT_WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")), "")
        hit = lambda i: F.exists("spans", lambda s: (s["a"] <= i + 1) & (i + 1 < s["b"]))
        kept = F.transform(own, lambda w, i: F.when(hit(i), "").otherwise(F.concat(F.get(between, i), w)))
        return F.concat(F.array_join(kept, ""), F.element_at(between, -1))

    cut = F.when(F.size("spans") > 0, let(F.split(text, WORD), rebuilt)).otherwise(text)
    return found.select(F.col("row").withField(text_col, cut).alias("row")).select("row.*")
