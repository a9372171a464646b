"""Token counts and alignments against the tokenizer libraries and plain loops."""

import collections
import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credence.llm import alignment, arrays, token_counts

SCHEMA = "doc_id long, text string, n_tokens string, pairs string, _id int, _th int"
SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<0x41>"]


def texts():
    """Nulls, blanks, special strings, other scripts, runs of one sign, long words and long texts."""
    r = random.Random(3)
    signs = [*range(32, 127), *range(160, 600), *range(0x300, 0x500), *range(0x2000, 0x2070), 0x4E00, 0x1F600, 10, 10, 32, 32, 9, 13, 28, 0x85]
    rows = [None, "", " ", "  \n\t ", "a", " a ", "a  ", "a\n  b", "a\n\n b", "It's I'LL 12²½ x", "日本語 テキスト " * 9, "a" * 3000, "ab" * 4000, "Σίσυφος ΑΣ"]
    rows += ["İstanbul ǅ é é", "a\x1cb\x85c d", "▁x▁ y", "a\0b", "x  y", "🎉🎉 x", "word " * 5000, " ".join(SPECIAL), "x".join(SPECIAL)]
    rows += ["".join(chr(r.choice(signs)) for _ in range(r.randint(1, 200))) for _ in range(150)]
    word = lambda: "".join(r.choices(["ka", "Lo", "mi", "né", "ra", "tu", "the", "ing,"], k=r.randint(1, 4)))
    rows += [" ".join(word() for _ in range(r.randint(1, 300))) for _ in range(60)]
    return rows + rows[-3:]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 7 else 5 if k in (8, 9) else k, t, "n", "p", 1, 2) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_counts_equal_the_library(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.default_vocabulary())
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want[(r.doc_id, len((r.text or "").encode()), n, n > 40)] += 1
    got = token_counts.token_counts(docs, limit=40)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert token_counts.token_counts(empty).collect() == []


def test_long_texts_in_parts(docs, monkeypatch):
    """Texts taken a few words at a time give what whole ones give."""
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([0] * len(rows)), pa.array([t for _, t in rows])], ["_id", "_th", "text"])

    def run():
        counted = token_counts.counting(token_counts.default_vocabulary())(iter([batch.select(["_id", "text"])]))
        aligned = alignment.aligning(*alignment.default_vocabularies())(iter([batch]))
        return [[r for b in found for r in b.to_pylist()] for found in (counted, aligned)]

    whole = run()
    for size in (7, 40):
        monkeypatch.setattr(token_counts, "SLICE", size)
        monkeypatch.setattr(alignment, "SLICE", size)
        for _, text in rows:
            parts = arrays.word_parts(text or "", size)
            assert "".join(parts) == (text or "") and all(p[0] == " " and not p.isspace() for p in parts[1:])
        assert run() == whole


def test_merging_one_place_a_round_gives_the_same():
    merger = token_counts.RankMerger(token_counts.default_vocabulary())
    rows = [b"a" * k for k in range(1, 40)] + [b"abcabcabc", b"understanding", b"hahahahaha", "né".encode()]
    at_once = merger.survivors(rows)
    assert merger.ordered
    merger.ordered = False
    assert np.array_equal(at_once, merger.survivors(rows))
    assert len(merger.survivors([])) == 0


def test_merges_that_build_on_later_ones(tmp_path):
    """Where a merge uses a symbol that a later one makes, only the leftmost place is merged in a round."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = token_counts.byte_letters()
    vocab = {c: k for k, c in enumerate(letters)} | {"aa": 256, "aaa": 257, "aaaa": 258}
    tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=[("aa", "a"), ("a", "a"), ("aa", "aa")]))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    path = str(tmp_path / "odd.json")
    tokenizer.save(path)
    merger = token_counts.RankMerger(path)
    assert not merger.ordered and not merger.plain
    rows = [b"a" * k for k in range(1, 30)]
    assert merger.survivors(rows).tolist() == [len(tokenizer.encode(r.decode()).ids) for r in rows]
    told = json.load(open(path, encoding="utf-8"))
    told["model"]["dropout"] = 0.1
    json.dump(told, open(path, "w", encoding="utf-8"))
    with pytest.raises(ValueError, match="byte-pair"):
        token_counts.RankMerger(path)


def plain_alignment(a, b, names_a, names_b):
    """Groups and links by a loop over bytes."""
    owner_a = [k for k, i in enumerate(a) for _ in names_a[i]]
    owner_b = [k for k, i in enumerate(b) for _ in names_b[i]]
    links = sorted(set(zip(owner_a, owner_b, strict=True)))
    groups, i, j = [], 0, 0
    for k in range(len(owner_a)):
        last = k + 1 == len(owner_a)
        if last or (owner_a[k] != owner_a[k + 1] and owner_b[k] != owner_b[k + 1]):
            groups.append((a[i : owner_a[k] + 1], b[j : owner_b[k] + 1]))
            i, j = owner_a[k] + 1, owner_b[k] + 1
    return groups, links


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_vocabularies()
    first, second = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    first.encode_special_tokens = True
    names_a, names_b = alignment.ByteTokens(path_a).bytes, alignment.PieceTokens(path_b).bytes
    done, counts = [], collections.Counter()
    for i, text in rows:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        raw = (" " + (text or "")).encode()
        if not text or b"".join(names_a[x] for x in a) != raw or b"".join(names_b[x] for x in b) != raw:
            done.append((i, [], [], [], []))
            continue
        groups, links = plain_alignment(a, b, names_a, names_b)
        pairs = [(a[x], b[y]) for x, y in links]
        counts.update(pairs)
        done.append((i, a, b, groups, pairs))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = collections.Counter()
    for i, a, b, groups, pairs in done:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if a else ""
        best = sum(counts[p] == most[p[1]] for p in pairs)
        out[(i, len(a), len(b), len(groups), len(pairs), best, sum(counts[p] for p in pairs), digest)] += 1
    return out


def test_alignment_equals_a_loop_over_bytes(docs, empty):
    scored, counts = alignment.align_tokenizers(docs)
    got = alignment.report(scored)
    want = brute_alignment([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert counts.where("best").count() > 100
    # pairs that are not broadcast come by a join, with the same result
    for heavy in (0, 50):
        rows = alignment.stage(alignment.aligned(docs, *alignment.default_vocabularies()), "rows")
        assert collections.Counter(tuple(r) for r in alignment.report(alignment.score_links(rows, counts, heavy)).collect()) == want
    scored, counts = alignment.align_tokenizers(empty)
    assert scored.collect() == [] and counts.collect() == []


def test_runs_are_skipped_and_shifts_kept():
    r = random.Random(1)
    for _ in range(300):
        size = r.randint(1, 200)
        cuts = sorted(r.sample(range(1, size), r.randint(0, size - 1)))
        common = [c for c in cuts if r.random() < r.choice([0.3, 0.95])]
        ends = [sorted({*common, *(c for c in cuts if r.random() < 0.2), size}) for _ in range(2)]
        a, b = ([e - s for s, e in zip([0, *x], x, strict=False)] for x in ends)
        names = [b"x" * k for k in range(size + 1)]
        groups, links = plain_alignment(a, b, names, names)
        link_a, link_b, end_a, end_b = alignment.align(*(np.array(x) for x in ends))
        assert sorted(zip(link_a.tolist(), link_b.tolist(), strict=True)) == links
        assert [x + 1 for x in end_a.tolist()] == np.cumsum([len(x) for x, _ in groups]).tolist()
        assert [x + 1 for x in end_b.tolist()] == np.cumsum([len(y) for _, y in groups]).tolist()


def test_heavy_pairs_are_bounded(spark):
    counts = spark.createDataFrame([(k, 1 + k % 40, True) for k in range(400)], "pair long, n long, best boolean")
    for bound in (0, 3, 40, 399, 400, 1000):
        least = alignment.heavy_from(counts, bound)
        assert counts.where(F.col("n") >= least).count() <= bound
        assert least == 0 or bound < 400
