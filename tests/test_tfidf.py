import math
import random
import re
import types
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credence.operators import tfidf as T
from credence.session import staged

DOCS = [
    "The cat sat on the mat", "A cat. a CAT!", "Café crème, café", "x y z", "", None,
    "the dog and the cat", "mat mat mat dog",
]


def grams(s):
    s = unicodedata.normalize("NFKD", (s or "").lower())
    words = re.findall(r"\b\w\w+\b", "".join(c for c in s if not unicodedata.combining(c)))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_force(docs, max_features=5000, min_df=1, fit_on=None):
    counts = [Counter(grams(d)) for d in (docs if fit_on is None else fit_on)]
    tf, df = Counter(), Counter()
    for c in counts:
        tf.update(c)
        df.update(c.keys())
    n = len(counts)
    least = min_df * n if isinstance(min_df, float) else min_df
    kept = sorted((t for t in tf if df[t] >= least), key=lambda t: (-tf[t], t))[:max_features]
    vocabulary = sorted(kept)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocabulary}
    out = {}
    for i, d in enumerate(docs):
        w = {t: (1 + math.log(k)) * idf[t] for t, k in Counter(grams(d)).items() if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out |= {(i, t): v / norm for t, v in w.items()}
    return vocabulary, out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "id int, text string").repartition(3)


@pytest.mark.parametrize("options", [{}, {"max_features": 7}, {"min_df": 2}, {"min_df": 0.25}])
def test_against_brute_force(frame, options):
    model = T.fit_tfidf(frame, "text", **options)
    vocabulary, weights = brute_force(DOCS, **options)
    assert model.terms == vocabulary and model.n_documents == len(DOCS)
    rows = T.transform_tfidf(frame, "id", "text", model).collect()
    assert {(r["id"], r["term"]): r["weight"] for r in rows} == pytest.approx(weights)
    assert all(vocabulary[r["idx"]] == r["term"] for r in rows)


def test_whole_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = dict(df.collect())
    got = {(r[0], r[1]): r[2] for r in T.count_terms(df, "doc_id", "text").collect()}
    assert got == {(i, t): k for i, d in docs.items() for t, k in Counter(grams(d)).items()}
    plan = T.count_terms(df, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("regexp_extract_all") == 1  # not copied into a filter


def test_vectors(frame):
    model = T.fit_tfidf(frame, "text", max_features=9)
    long = {(r["id"], r["idx"]): r["weight"] for r in T.transform_tfidf(frame, "id", "text", model).collect()}
    sign = F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)
    plain = T.tfidf_vectors(frame, "text", model).collect()
    biased = T.tfidf_vectors(frame, "text", model, sign=sign).collect()
    assert len(plain) == len(DOCS)
    for r in plain:
        assert r["features"].size == 9
        assert r["features"].norm(2) == pytest.approx(1.0) or r["features"].numNonzeros() == 0
        for idx, v in zip(r["features"].indices, r["features"].values):
            assert v == pytest.approx(long[(r["id"], idx)])
    for r in biased:
        s = 1 if r["id"] % 2 == 0 else -1
        v = r["features"].toArray()
        assert len(v) == 10 and v[9] == s
        assert np.all(v[:9] * s >= 0)


def test_transform_uses_the_fitted_vocabulary(spark, frame):
    train = frame.where("id in (0, 1)")
    model = T.fit_tfidf(train, "text")
    _, weights = brute_force(DOCS, fit_on=DOCS[:2])
    rows = T.transform_tfidf(frame, "id", "text", model).collect()
    assert {(r["id"], r["term"]): r["weight"] for r in rows} == pytest.approx(weights)
    plan = T.transform_tfidf(frame, "id", "text", model)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_fit_text_features(frame):
    model, out = T.fit_text_features(frame, "text")
    assert {"text_char_count", "text_empty_flag", "tfidf"} <= set(out.columns)
    assert out.count() == len(DOCS) and out.where("text_empty_flag = 1").count() == 2


def test_no_terms_and_bad_columns(spark, frame):
    empty = spark.createDataFrame([(1, "a b"), (2, "")], "id int, text string")
    model = T.fit_tfidf(empty, "text")
    assert model.terms == [] and T.transform_tfidf(frame, "id", "text", model).count() == 0
    with pytest.raises(KeyError):
        T.fit_tfidf(frame, "nope")
    with pytest.raises(ValueError):
        T.fit_tfidf(frame, "text", max_features=0)


def test_joined_vocabulary_gives_the_same_weights(frame):
    kept, n = T.fit_vocabulary(frame, "text", max_features=12)
    joined = T.weigh_terms(T.count_terms(frame, "id", "text"), "id", kept, n).collect()
    model = T.fit_tfidf(frame, "text", max_features=12)
    rows = T.transform_tfidf(frame, "id", "text", model).collect()
    assert {(r["id"], r["term"]): r["weight"] for r in joined} == pytest.approx(
        {(r["id"], r["term"]): r["weight"] for r in rows})


@pytest.mark.parametrize("most", [T.BROADCAST_TERMS, 3])
def test_joined_weights_shuffle_known_terms_once(spark, most, monkeypatch):
    """a vocabulary that can be sent is not joined by a shuffle, and the counts are read once; repeated ids share a norm,
    rows without an id have no weight."""
    monkeypatch.setattr(T, "BROADCAST_TERMS", most)
    counts = [("a", "x", 2), ("a", "y", 1), ("a", "zz", 9), ("b", "x", 1), ("a", "x", 3), (None, "x", 4), ("c", "zz", 1)]
    vocabulary = spark.createDataFrame([("x", 3), ("y", 1), ("u", 1), ("v", 1)], "term string, df long")
    found = T.weigh_terms(spark.createDataFrame(counts, "id string, term string, tf long"), "id", vocabulary, 5)
    idf = {"x": math.log(6 / 4) + 1, "y": math.log(6 / 2) + 1}
    raw = [(i, t, (1 + math.log(n)) * idf[t]) for i, t, n in counts if i and t in idf]
    norm = {i: math.sqrt(sum(w * w for j, _, w in raw if j == i)) for i in "ab"}
    want = sorted((i, t, w / norm[i]) for i, t, w in raw)
    got = sorted(tuple(r) for r in found.collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and ("strategy=broadcast" in plan) == (most > 4)


@pytest.mark.parametrize("k", [1, 5, 40, 300, 5000])
def test_most_frequent_terms_without_the_tail(spark, k, monkeypatch):
    """Equal to summing everything, for any number of parts, and most of the tail stays where it is."""
    r = random.Random(k)
    words = [f"w{j:04d}" for j in range(3000)]
    texts = [" ".join(words[min(2999, int(r.paretovariate(0.7)) - 1)] for _ in range(r.randint(0, 80))) for _ in range(600)] + [None, "", "w0001 w0001"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(9)
    counts, holding = Counter(), Counter()
    for t in texts:
        counts.update((t or "").split())
        holding.update(set((t or "").split()))
    for least in (1, 4):
        want = sorted((-n, t) for t, n in counts.items() if holding[t] >= least)[:k]
        kept, n = T.fit_vocabulary(df, "text", max_features=k, ngram_range=(1, 1), min_df=least)
        assert n == 603 and [(-x["tf"], x["term"], x["df"]) for x in kept.collect()] == [(a, t, holding[t]) for a, t in want]
    parts = T.stage(T.local_counts(df, "text", (1, 1)), "parts")
    monkeypatch.setattr(T, "BROADCAST_TERMS", 0)
    assert [x["term"] for x in T.most_frequent(parts, k).collect()] == [t for _, t in sorted((-n, t) for t, n in counts.items())[:k]]
    if k == 5:  # a share of the parts' counts moves
        before = set(staged())
        T.most_frequent(parts, k)
        (able,) = [spark.read.parquet(p) for p in set(staged()) - before]
        assert parts.join(able, "term", "left_semi").count() < parts.count() / 4


def test_parts_are_closed_when_full(monkeypatch):
    """A task that meets many terms hands them on in several parts; nothing is lost."""
    monkeypatch.setattr(T, "PART_TERMS", 10)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: types.SimpleNamespace(partitionId=lambda: 3))
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))
    docs = [[{"term": f"t{(7 * d + j) % 40}", "tf": 1 + j % 3} for j in range(6)] for d in range(30)] + [[], None]
    batches = [pa.RecordBatch.from_arrays([pa.array(docs[k : k + 4], kind)], ["_terms"]) for k in range(0, len(docs), 4)]
    found = pa.Table.from_batches(list(T._local_counts(iter(batches)))).to_pylist()
    want = Counter()
    for doc in docs:
        for x in doc or []:
            want[x["term"]] += x["tf"]
    got = Counter()
    for x in found:
        got[x["term"]] += x["tf"]
    got.pop(None, None)
    assert got == want and len({x["part"] for x in found}) > 2
    assert sum(x["documents"] for x in found) == len(docs)
    assert list(T._local_counts(iter([]))) == []
