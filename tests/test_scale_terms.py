"""Counting of terms whose memory must not grow with the texts."""

import random
import types
from collections import Counter

import pyarrow as pa

from credence.operators import tfidf as T


def test_terms_reach_the_counts_one_by_one(monkeypatch):
    """a document's terms may come in several batches and fall into several parts; nothing is lost."""
    monkeypatch.setattr(T, "PART_TERMS", 12)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: types.SimpleNamespace(partitionId=lambda: 3))
    r = random.Random(5)
    docs = [{f"t{r.randint(0, 60)}": r.randint(1, 4) for _ in range(r.randint(0, 30))} for _ in range(25)] + [{}]
    flat = [x for doc in docs for x in [{"term": None, "tf": 0}, *({"term": t, "tf": n} for t, n in doc.items())]]
    kind = pa.struct([("term", pa.string()), ("tf", pa.int64())])
    batches = [pa.RecordBatch.from_arrays([pa.array(flat[k : k + 7], kind)], ["_term"]) for k in range(0, len(flat), 7)]
    found = pa.Table.from_batches(list(T._local_counts(iter(batches)))).to_pylist()
    tf, df = Counter(), Counter()
    for x in found:
        tf[x["term"]] += x["tf"]
        df[x["term"]] += x["df"]
    tf.pop(None, None), df.pop(None, None)
    assert tf == sum((Counter(d) for d in docs), Counter()) and df == sum((Counter(list(d)) for d in docs), Counter())
    assert sum(x["documents"] for x in found) == len(docs) and len({x["part"] for x in found}) > 2
