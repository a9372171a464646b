"""Toxicity by two class-conditional Kneser-Ney models over the same backoff.

An expression is a lower-cased word of letters. Its count in a class is a continuation
count: in how many labelled documents of the class (contexts) it stands. Each class keeps its counts less an
absolute discount, and gives the discounted mass to one backoff that both
classes share: the share of all documents, labelled or not, that hold the expression.

    P(w | class) = max(c(w, class) - D, 0) / N(class) + lambda(class) * P(w)

An expression that no class holds more than ``D`` times thus has the classes' shares of discounted mass as its ratio, the same
for all such. As even a toxic document is
mostly ordinary prose, its likelihood is the mixture ``(1 - E) * ordinary + E * toxic``. Every expression of a document
counts, whichever class it speaks for. The difference of the log-likelihoods, divided by
the length and by its root, goes through a logistic curve fitted on labelled documents that the counts did not see.

The counts come from one pass over every document and stay a distributed table that grows with the vocabulary. Every
labelled document is counted or calibrated on; none is left out. Up to ``BROADCAST_LABELS`` labels go to the documents,
more are joined by a shuffle. Scoring holds ``BLOCK_WORDS`` expressions of a weight of their own at a time; where there are more, the
documents pass once for each block, and the sums add up. The curve is fitted by sums over the points, which stay distributed.

Defined cases: a null or empty text, or one without letters, has length 0 and differences 0 and gets the
score of that point. Repeated rows score alike. Where the labelled documents are so few that the counts or the curve
would lack a class, both are made of all of them. Where no expression tells the classes apart (no label, none that matches
a document, labels of one class), nothing is known against any document: every score is ``UNKNOWN``, below the threshold.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.llm.labels import fit_logistic_rows, held_out, logistic, training_labels
from credence.session import release, stage, staged

#: Labels that are sent to all tasks, at most; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Expressions of a weight of their own that a scoring task holds at a time.
BLOCK_WORDS = 500_000
DISCOUNT = 1.0
MIXED = 0.02
THRESHOLD = 0.3
UNKNOWN = 0.1
#: Differences of the log-likelihoods by length, by its root, and the log of the length.
SPOTS = ("d_mean", "d_root", "d_size")
#: Distinct words a task counts before it hands its counts on.
HELD_WORDS = 200_000
LETTERS = bytes(32 if i < 128 and not chr(i).isalpha() else i for i in range(256))


def expressions(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(LETTERS).split()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y) to (word, documents, toxic documents, ordinary documents), added up inside the task."""
    total, toxic, plain = Counter(), Counter(), Counter()

    def flush():
        words = list(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(words, pa.binary()), pa.array(list(total.values()), pa.int64()),
                pa.array([toxic[w] for w in words], pa.int64()), pa.array([plain[w] for w in words], pa.int64()),
            ],
            ["word", "n", "toxic", "plain"],
        )
        for counter in (total, toxic, plain):
            counter.clear()

    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = set(expressions(text.as_py()))
            total.update(words)
            if y is not None:
                (toxic if y else plain).update(words)
            if len(total) > HELD_WORDS:
                yield from flush()
    yield from flush()


def differences(weights, text_col: str | None = None, more: bool = False, base: float = 0.0):
    """A mapInArrow function that adds d_mean, d_root and d_size to its first column. The text is
    the last column or, if named, a field of the first, so that it crosses to Python once. Each expression weighs ``base``
    and what ``weights`` has above that. With ``more`` the differences
    that other expressions made, in the three columns after the first, are added to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.value
        for batch in batches:
            found = np.zeros((batch.num_rows, 3))
            texts = batch.column(0).field(text_col) if text_col else batch.column(batch.num_columns - 1)
            for k, text in enumerate(texts):
                words = expressions(text.as_py())
                if words:
                    n = len(words)
                    total = base * n + sum([known[w] for w in words if w in known])
                    found[k] = total / n, total / math.sqrt(n), math.log(n)
            if more:
                for j in (0, 1):
                    found[:, j] += batch.column(j + 1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(found[:, j]) for j in range(3)]],
                [batch.schema.names[0], *SPOTS],
            )

    return run


def weight_blocks(counts: DataFrame) -> Iterator:
    """Broadcasts of the expressions that weigh other than the rest, ``BLOCK_WORDS`` or about so many in each (a single one may
    be empty), what every expression weighs before, told with the first, and whether it is the last."""
    spark = counts.sparkSession
    weights, base = expression_weights(counts)
    weighted = stage(weights, "expression-weights")
    blocks = max(1, -(-weighted.count() // BLOCK_WORDS))
    for block in range(blocks):
        rows = weighted.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == block).toArrow().to_pydict()
        known = spark.sparkContext.broadcast(dict(zip(rows["word"], rows["weight"], strict=True)))
        yield known, 0.0 if block else base, block == blocks - 1


def with_differences(rows: DataFrame, blocks: list, text_col: str) -> DataFrame:
    """``rows`` (one struct column ``row``) with the three differences; a pass for each block of expressions. What a pass
    but the last one writes is kept until the next has read it."""
    found = T.StructType([rows.schema["row"], *[T.StructField(c, T.DoubleType()) for c in SPOTS]])
    written = []
    for k, (weights, base, last) in enumerate(blocks):
        rows = rows.mapInArrow(differences(weights, text_col, more=k > 0, base=base), found)
        if not last:
            rows = stage(rows, f"differences-{k}")
            release(rows.sparkSession, written)
            written = staged()[-1:]
    return rows


def expression_weights(counts: DataFrame) -> tuple[DataFrame, float]:
    """(word, weight) and a base: the log of the mixture over the ordinary likelihood is ``base + weight``.

    Where neither class holds a word more than ``DISCOUNT`` times, both its probabilities are backoff alone, and the ratio
    is that of the discounted masses whatever the word: that is ``base``, and the table holds the other words.
    """
    sums = counts.agg(
        *[F.sum(c).alias(c) for c in ("n", "toxic", "plain")],
        *[F.sum(F.least(F.col(c), F.lit(DISCOUNT))).alias(f"cut_{c}") for c in ("toxic", "plain")],
    ).first()
    if not sums["n"] or not sums["toxic"] or not sums["plain"]:
        return counts.where("false").select("word", F.lit(0.0).alias("weight")), 0.0
    left = {c: sums[f"cut_{c}"] / sums[c] for c in ("toxic", "plain")}

    def probability(c: str):
        own = F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / float(sums[c])
        return own + F.lit(left[c]) * F.col("n") / float(sums["n"])

    base = math.log(1 - MIXED + MIXED * left["toxic"] / left["plain"])
    weight = F.log(1 - MIXED + MIXED * probability("toxic") / probability("plain")) - F.lit(base)
    told = (F.col("toxic") > DISCOUNT) | (F.col("plain") > DISCOUNT)
    return counts.where(told).select("word", weight.alias("weight")), base


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """``docs`` as struct ``row`` with ``score``, the probability of being toxic."""
    fitting = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(4)) != 0
    usable = stage(training_labels(labels, label).withColumn("fit", fitting), "toxicity-labels")
    shares = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    few = sum(shares.values()) <= BROADCAST_LABELS
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = plain.join(F.broadcast(usable) if few else usable, plain["id"] == usable["doc_id"], "left")
    parts = known.where("y is not null").select("y", "fit").distinct().collect()  # four at most
    apart = len(parts) == 4  # both classes are learnt from, and both are left
    learnt = known.select("text", F.when(F.col("fit"), F.col("y")).alias("y") if apart else F.col("y"))
    counts = stage(
        learnt.mapInArrow(count_words, "word binary, n long, toxic long, plain long")
        .groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "plain")]),
        "word-counts",
    )
    blocks = list(weight_blocks(counts))

    left = known.where(~F.col("fit") if apart else F.col("y").isNotNull()).select(F.struct("y", "text").alias("row"))
    points = stage(with_differences(left, blocks, "text").select("row.y", *SPOTS), "toxicity-points")
    seen = {r["y"]: r["n"] for r in points.groupBy("y").agg(F.count("*").alias("n")).collect()}
    whole = sum(seen.values()) / max(1, sum(shares.values()))
    w, centre, scale = fit_logistic_rows(
        points, list(SPOTS), {c: shares.get(c, 0) / max(1, seen.get(c, 0)) * whole for c in (0, 1)}
    )
    spread = with_differences(docs.select(F.struct("*").alias("row")), blocks, text_col)
    power = sum(
        (F.col(c) - float(m)) / float(s) * float(b)
        for c, m, s, b in zip(SPOTS, centre, scale, w[:-1], strict=True)
    ) + float(w[-1])
    return spread.select("row", (1 / (1 + F.exp(-power)) if any(weights.value for weights, *_ in blocks) else F.lit(UNKNOWN)).alias("score"))


def report(scored: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    return scored.select(
        F.col(f"row.{id_col}").alias("doc_id"), held_out(f"row.{id_col}").alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def ordinary(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The input without the documents scored as toxic."""
    return score(docs, labels).where(F.col("score") < threshold).select("row.*")


__all__ = ["expressions", "logistic", "ordinary", "report", "score"]
