"""The pipeline on a small table, its stages, and what it leaves behind."""

import collections
import math
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from credence.llm import packing, toxicity
from credence.llm.labels import fit_logistic, logistic
from credence.session import release, staged
from pyspark.sql import functions as F


def test_stages_pass_documents_on(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, sf).checkpoint()
        assert docs.columns == columns and 0 < docs.count() <= left, name
        left = docs.count()
    assert docs.where("n_chars <> length(text)").isEmpty()


def test_run_leaves_only_its_result(spark, sf):
    release(spark, corpus_pipeline._LEFT)
    before = staged()
    packed = corpus_pipeline.run(spark, sf)
    assert packed.where("length > 2048 or offset + length > 2048").isEmpty()
    assert packed.select("doc_id").distinct().count() > 50
    assert len(staged()) == len(before) + 1


def test_steps_send_small_batches(spark):
    """Memory on check_h: texts reach the workers at most ``BATCH_ROWS`` at a time, 10,000 before; no row is left out."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    count = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    step = corpus_pipeline._stage_of_pipeline(lambda _, docs, d: docs.mapInArrow(count, "n long"))
    try:
        for given, most in ((10_000, 2_000), (0, 2_000), (300, 300)):
            spark.conf.set(rows, given)
            sizes = [r["n"] for r in step(spark, spark.range(0, 9_000, 1, 1), "").collect()]
            assert sum(sizes) == 9_000 and max(sizes) == most
    finally:
        spark.conf.set(rows, before)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, spans string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\r\x0b\x0c"


def corpus():
    """(doc_id, text): insults, passages, copies, near copies and test items among prose; null and repeated ids, null and empty texts."""
    r = random.Random(8)
    word = lambda: "".join(r.choices(["ka", "lo", "mi", "né", "ra", "tu", "so"], k=r.randint(2, 4)))
    line = lambda n=8: " ".join(word() for _ in range(n))
    page = lambda n=6: "\n".join(line() for _ in range(n))
    rows = [(i, page()) for i in range(80)]
    rows += [(100 + i, page(3) + " you vile stinking wretch, vile filth " + page(2)) for i in range(40)]
    passage, base = page(4), page(12)
    rows += [(200 + i, page(2) + "\n" + passage + "\n" + page(2)) for i in range(5)]
    words = base.split(" ")
    rows += [(300 + i, " ".join([*words[: 5 * i], f"new{i}", *words[5 * i + 1 :]])) for i in range(6)] + [(310, base), (311, base)]
    item = line(14).replace("é", "e")
    rows += [(400 + i, page(2) + " " + item.upper() + " " + page(1)) for i in range(3)]
    rows += [(None, page()), (None, page()), (None, base), (7, page()), (8, rows[8][1]), (500, None), (501, ""), (502, " \n "), (503, "two words")]
    long = line(90).split(" ")  # one line, which line dedup leaves alone
    rows += [(700 + i, " ".join([*long[: 7 * i], f"new{i}", *long[7 * i + 1 :]])) for i in range(10)] + [(720, " ".join(long)), (None, " ".join(long))]
    rows += [(600, "\n".join(passage.split("\n")[:3]))]
    return rows, [(1, item), (2, None), (3, "")]


@pytest.fixture(scope="module", params=["labels", "no labels"])
def given(spark, request, tmp_path_factory):
    rows, items = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    labels = [(i, 1, int(100 <= i < 200)) for i, _ in rows if i is not None and i < 320] + [(None, 1, 1), (7, 0, 0), (9999, 0, 1)]
    if request.param == "no labels":
        labels = []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "r", 0.5, "x") for i, t in rows], SCHEMA)
    docs.repartition(5).write.parquet(f"{path}/documents.parquet")
    return path, {i: y for i, _, y in labels if i is not None}


def content(rows):
    return collections.Counter((r.doc_id, r.text) for r in rows)


def not_toxic(spark, rows, labels):
    """The two models written out over dictionaries."""
    def words(text):
        return "".join(c if c.isalpha() or ord(c) > 127 else " " for c in (text or "").lower()).split()

    taught = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    ids = spark.createDataFrame([(i,) for i in taught], "doc_id long")
    fit = {r[0] for r in ids.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(4)) != 0).collect()}
    held = [(taught[r.doc_id], r.doc_id in fit, r.text) for r in rows if r.doc_id in taught]
    apart = len({x[:2] for x in held}) == 4
    total, by = collections.Counter(), {0: collections.Counter(), 1: collections.Counter()}
    for r in rows:
        total.update(set(words(r.text)))
        if r.doc_id in taught and (not apart or r.doc_id in fit):
            by[taught[r.doc_id]].update(set(words(r.text)))
    sums = {y: sum(c.values()) for y, c in by.items()}
    if not sums[0] or not sums[1]:
        return rows
    n = sum(total.values())

    def p(w, y):
        cut = sum(min(c, toxicity.DISCOUNT) for c in by[y].values())
        return max(by[y][w] - toxicity.DISCOUNT, 0) / sums[y] + cut / sums[y] * total[w] / n

    ratio = {w: p(w, 1) / p(w, 0) for w in by[1] if by[1][w] > toxicity.DISCOUNT}
    weight = {w: math.log(1 - toxicity.MIXED + toxicity.MIXED * x) for w, x in ratio.items() if x > 1}

    def spots(text):
        own = words(text)
        s, k = sum(weight.get(w, 0) for w in own), len(own)
        return [s / k, s / math.sqrt(k), math.log(k)] if k else [0, 0, 0]

    left = [(y, spots(t)) for y, f, t in held if not apart or not f]
    y = np.array([a for a, _ in left], float)
    share = collections.Counter(taught.values())
    scale = np.where(y == 1, share[1] / max(1, (y == 1).sum()), share[0] / max(1, (y == 0).sum())) * len(y) / sum(share.values())
    model = fit_logistic(np.array([b for _, b in left]), y, scale)
    return [r for r in rows if logistic(np.array([spots(r.text)]), model)[0] < toxicity.THRESHOLD]


def without_later_passages(rows):
    documents = sorted({(r.doc_id, r.text) for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    first, cut = {}, {}
    lines = {d: [(n, x.strip(BLANKS)) for n, x in enumerate((d[1] or "").split("\n")) if x.strip(BLANKS)] for d in documents}
    for d in documents:
        for k in range(len(lines[d]) - 2):
            first.setdefault(tuple(x for _, x in lines[d][k : k + 3]), (d, k))
    for d in documents:
        gone = {n for k in range(len(lines[d]) - 2) if first[tuple(x for _, x in lines[d][k : k + 3])] != (d, k) for n, _ in lines[d][k : k + 3]}
        kept = None if d[1] is None else "\n".join(x for n, x in enumerate(d[1].split("\n")) if n not in gone)
        cut[d] = None if gone and not kept.strip() else (d[0], kept)
    return collections.Counter(cut[r.doc_id, r.text] for r in rows if cut[r.doc_id, r.text])


def groups_of_similar(rows):
    """Components of the different texts that have words."""
    sets = {}
    for t in {r.text for r in rows}:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        if w:
            sets[t] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    groups = [{t} for t in sets]
    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                one, two = (next(g for g in groups if x in g) for x in (a, b))
                if one is not two:
                    groups.remove(two)
                    one |= two
    return groups


def hits_an_item(text, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    own = cut(text)
    for item in map(cut, items):
        n = min(10, len(item))
        windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
        if any(tuple(own[k : k + n]) in windows for k in range(len(own) - n + 1 if n else 0)):
            return True
    return False


def test_every_stage_equals_brute_force(spark, given):
    path, labels = given
    items = [t for _, t in corpus()[1]]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = step(spark, docs, path).checkpoint()
        after = docs.collect()
        assert docs.columns == columns
        if name == "toxicity":
            assert content(after) == content(not_toxic(spark, before, labels))
            assert len(before) - len(after) > 20 if labels else after
            assert all(not 100 <= (r.doc_id or 0) < 140 for r in after) or not labels
        elif name == "line dedup":
            assert content(after) == without_later_passages(before)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
        elif name == "n-gram Jaccard join":
            groups, left = groups_of_similar(before), content(after)
            assert sum(left.values()) == len(groups) + sum(1 for r in before if not (r.text or "").strip())
            for group in groups:
                (kept,) = [d for d in left.elements() if d[1] in group]
                ids = [r.doc_id for r in before if r.text in group]
                assert kept[0] == min((i for i in ids if i is not None), default=None)
            assert len(groups) < len(before) - 8
        else:
            assert content(after) == content([r for r in before if not hits_an_item(r.text, items)])
            assert 0 < len(before) - len(after) <= 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_vocabulary())
    want = collections.Counter((r.doc_id, 1 + len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.length) for r in pieces) == want  # none is longer than a sequence here


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
