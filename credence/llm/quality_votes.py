"""Quality by votes of the nearest labelled documents in a latent-semantic space.

The terms of a text are the shapes of its words (letter case, digits, signs) and how its words,
word triples and lines repeat; the words themselves say what a text is about, not how good it is. Terms are hashed to ``SLOTS``
columns and weighted by log frequency and by the inverse document frequency over all documents.
A truncated singular value decomposition of at most ``SAMPLE`` labelled rows gives the latent axes; those rows'
vectors, a few megabytes, are broadcast. Every document's vector is then multiplied, block by block, with all of
them: the ``NEIGHBOURS`` nearest (and ties) vote with their label, weighted by similarity to the power ``SHARPNESS``.

Defined cases: null and empty texts have the length term only and get a score like any other.
Repeated rows score alike. Without labels every score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.labels import held_out, sample, training_labels
from credence.session import stage

SLOTS = 1024
HASHED = 1000
REPEATS_NEXT, REPEATS_SECOND, REPEATS_TRIPLE, REPEATS_LINE, REPEATS_ANY, LENGTH = range(HASHED, HASHED + 6)
SAMPLE = 8_192
AXES = 48
NEIGHBOURS = 15
SHARPNESS = 8
THRESHOLD = 0.7
BLOCK = 512


def shape(word: str) -> str:
    """Runs of letters and digits as one sign each: ``Ab,`` to ``Aa,``."""
    found, last = [], ""
    for c in word:
        kind = "0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        if kind != last:
            found.append(kind)
            last = kind
    return "".join(found)


class Words(dict):
    """For each word a number: 53 bits that tell words apart, 10 bits for its shape."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        slot = zlib.crc32(shape(word).encode("utf-8", "replace")) % HASHED
        self[word] = number = (hash(word) & (2**53 - 1)) << 10 | slot
        return number


def term_weights(text: str | None, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Slots and log frequencies of a text's terms."""
    text = text or ""
    found = text.split()
    n = len(found)
    counts = np.zeros(SLOTS, np.float64)
    counts[LENGTH + min(17, n.bit_length())] = -1
    if n:
        ids = np.fromiter(map(words.__getitem__, found), np.int64, n)
        counts[:HASHED] = np.bincount(ids & 1023, minlength=HASHED)[:HASHED]
        names = (ids >> 10).astype(np.uint64)
        counts[REPEATS_NEXT] = np.count_nonzero(names[1:] == names[:-1])
        counts[REPEATS_SECOND] = np.count_nonzero(names[2:] == names[:-2])
        counts[REPEATS_ANY] = n - len(set(found))
        if n > 2:
            triples = np.sort((names[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ names[1:-1]) * np.uint64(0xD6E8FEB86659FD93) ^ names[2:])
            same = triples[1:] == triples[:-1]
            counts[REPEATS_TRIPLE] = same.sum() + (same & ~np.concatenate(([False], same[:-1]))).sum()
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        counts[REPEATS_LINE] = (len(lines) - len(set(lines))) * max(1, n // len(lines))
    slots = np.flatnonzero(counts)
    values = counts[slots]
    return slots, np.where(values < 0, 1.0, np.log1p(100 * np.maximum(values, 0) / max(n, 1)))


def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        found = [term_weights(t.as_py(), words) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([s.tolist() for s, _ in found], pa.list_(pa.int32())),
                pa.array([v.tolist() for _, v in found], pa.list_(pa.float32())),
            ],
            ["doc_id", "slots", "weights"],
        )


def dense(slots: pa.Array, weights: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Unit rows of weighted term frequencies."""
    sizes = np.diff(slots.offsets.to_numpy())
    rows = np.zeros((len(slots), SLOTS), np.float32)
    rows[np.repeat(np.arange(len(slots)), sizes), slots.flatten().to_numpy()] = weights.flatten().to_numpy()
    rows *= idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def latent(rows: np.ndarray, axes: np.ndarray) -> np.ndarray:
    found = rows @ axes
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)


def vote(model):
    """A mapInArrow function from (doc_id, slots, weights) to (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, axes, vectors, labels = model.value
        nearest = min(NEIGHBOURS, len(labels))
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            for at in range(0, batch.num_rows if nearest else 0, BLOCK):
                part = batch.slice(at, BLOCK)
                cosine = latent(dense(part.column(1), part.column(2), idf), axes) @ vectors.T
                np.maximum(cosine, 1e-6, out=cosine)
                least = np.partition(cosine, len(labels) - nearest, axis=1)[:, len(labels) - nearest]
                strength = np.where(cosine >= least[:, None], cosine, 0)
                for _ in range(SHARPNESS.bit_length() - 1):
                    strength *= strength
                total = strength.sum(1, dtype=np.float64)
                scores[at : at + part.num_rows] = np.where(total > 0, (strength @ labels) / np.maximum(total, 1e-300), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(scores, 0.0, 1.0))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, score) of every row."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    terms = stage(plain.mapInArrow(featurise, f"doc_id {kind}, slots array<int>, weights array<float>"), "text-terms")
    n = terms.count()
    held = {r["slot"]: r["n"] for r in terms.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).collect()}
    idf = np.array([np.log((1 + n) / (1 + held.get(k, 0))) + 0.3 for k in range(SLOTS)], np.float32)

    chosen = sample(training_labels(labels, label), SAMPLE)
    # an id that stands in several rows counts once, with its smallest vector
    taught = terms.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("slots", "weights")).alias("v"))
    known = taught.select("doc_id", "y", "v.slots", "v.weights").orderBy("doc_id").toArrow().combine_chunks()
    if known.num_rows:
        rows = dense(known["slots"].combine_chunks(), known["weights"].combine_chunks(), idf)
        _, axes = np.linalg.eigh((rows.T @ rows).astype(np.float64))
        axes = np.ascontiguousarray(axes[:, ::-1][:, :AXES], np.float32)
        model = (idf, axes, latent(rows, axes), known["y"].to_numpy().astype(np.float32))
    else:
        model = (idf, np.zeros((SLOTS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
    return terms.mapInArrow(vote(spark.sparkContext.broadcast(model)), f"doc_id {kind}, score double")


def report(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
