"""op6: every label is learnt from, however many there are (F1)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence import session
from credence.llm import toxicity
from credence.llm.labels import fit_logistic, fit_logistic_rows, training_labels


def test_a_word_of_the_last_labels_counts(spark):
    """Only the last toxic documents in the order of the id's hash hold a word: a sample of 12,000 would not know it."""
    ids = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    usable = [r["doc_id"] for r in training_labels(ids, "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    late = usable[20_000:]
    told = {i: 1 if k < 13_000 or k >= 20_000 else 0 for k, i in enumerate(usable)}
    rows = [(i, "zorch is here" if i in set(late[:2000]) else "vile words here" if y else "fine words here") for i, y in told.items()]
    labels = spark.createDataFrame([(i, y) for i, y in told.items()], "doc_id long, toxic int")
    docs = spark.createDataFrame([*rows, (-1, "zorch is here"), (-2, "fine words here")], "doc_id long, text string")
    found = {r["id"]: r["score"] for r in toxicity.score(docs, labels).where("row.doc_id < 0").select("row.doc_id", "score").toDF("id", "score").collect()}
    assert found[-1] > 0.5 and found[-1] > found[-2] + 0.3


def test_blocks_and_shuffled_labels_score_alike(spark, monkeypatch):
    r = np.random.default_rng(0)
    rows = [(i, " ".join(r.choice(["bad", "worse", "vile", "so", "it", "is", "a", "day"], 6).tolist() + (["foul", "mean"] if i % 3 == 0 else []))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (7, None), (None, "bad day")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(250)], "doc_id long, toxic int")
    key = lambda df: sorted((str(x["d"]), round(x["score"], 9)) for x in df.select(F.col("row.doc_id").alias("d"), "score").collect())
    whole = key(toxicity.score(docs, labels))
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 1)
    assert key(toxicity.score(docs, labels)) == whole and len(whole) == 302


def test_the_curve_of_sums_is_the_curve_of_rows(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 2))
    y = (x[:, 0] + r.normal(size=200) > 0).astype(float)
    points = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y)], "y int, p double, q double")
    got = fit_logistic_rows(points, ["p", "q"], {0: 0.7, 1: 1.4})
    want = fit_logistic(x, y, np.where(y == 1, 1.4, 0.7))
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-7)
    fit_logistic_rows(points.where("false"), ["p", "q"], {0: 0.0, 1: 0.0})


def test_every_expression_counts(spark):
    """words that speak for the ordinary class, and those that a toxic document holds once or not at all, weighed nothing."""
    counts = {"vile": (9, 6, 1), "day": (20, 2, 12), "calm": (8, 0, 7), "once": (3, 1, 1), "seen": (5, 1, 0), "far": (4, 0, 0), "both": (6, 3, 3)}
    frame = spark.createDataFrame([(w.encode(), *c) for w, c in counts.items()], "word binary, n long, toxic long, plain long")
    rows, base = toxicity.expression_weights(frame)
    known = {bytes(r["word"]): r["weight"] for r in rows.collect()}
    total = [sum(c[k] for c in counts.values()) for k in range(3)]

    def likelihood(word, k):
        backoff = sum(min(c[k], 1) for c in counts.values()) / total[k] * counts[word][0] / total[0]
        return max(counts[word][k] - 1, 0) / total[k] + backoff

    told = {w: np.log((0.98 * likelihood(w, 2) + 0.02 * likelihood(w, 1)) / likelihood(w, 2)) for w in counts}
    assert told["calm"] < told["day"] < 0 < told["vile"] and set(known) == {b"vile", b"day", b"calm", b"both"}
    for w, want in told.items():
        assert base + known.get(w.encode(), 0.0) == pytest.approx(want, abs=1e-12)

    texts = ["calm calm far vile", "once seen", "", None, "Day, both!"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").select(F.struct("text").alias("row"))
    block = spark.sparkContext.broadcast(known)
    found = {r["row"]["text"]: r for r in toxicity.with_differences(docs, [(block, base, True)], "text").collect()}
    for t in texts:
        words = [w.decode() for w in toxicity.expressions(t)]
        assert found[t]["d_mean"] == pytest.approx(sum(told[w] for w in words) / max(1, len(words)), abs=1e-12)


def test_passes_over_blocks_keep_one_table(spark, monkeypatch):
    """with more expressions to weigh there are more passes; their tables must not pile up."""
    docs = spark.createDataFrame([("a b c d",), ("b b",), (None,)], "text string").select(F.struct("text").alias("row"))
    weights = [{b"a": 1.0}, {b"b": 2.0}, {b"c": 4.0}, {}]
    blocks = [(spark.sparkContext.broadcast(w), 0.5 * (k == 0), k == 3) for k, w in enumerate(weights)]
    before = len(session.staged())
    found = {r["row"]["text"]: r["d_mean"] for r in toxicity.with_differences(docs, blocks, "text").collect()}
    assert found == {"a b c d": 9.0 / 4, "b b": 2.5, None: 0.0} and len(session.staged()) == before + 1
