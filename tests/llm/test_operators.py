"""Each operator against a brute-force version, on rows picked for their edge cases."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.llm import decontaminate, jaccard, line_dedup, packing, preference, quality_votes, rules, sharding, substrings, toxicity
from credence.llm.common import connected, gapless_rank
from credence.llm.wordpieces import WordPieces

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BLANKLESS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, score double, row string, n_words int, spans string, kept string, _id int"


def corpus():
    """(doc_id, text): nulls, empty and long texts, copies, near copies, shared passages, other scripts."""
    r = random.Random(5)
    word = lambda: "".join(r.choices(["the", "Ka", "lo", "mi", "né", "ra", "tu"], k=r.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    page = lambda lines: "\n".join(prose(r.randint(4, 9)) for _ in range(lines))
    base, passage = page(14), page(5)
    rows = [(i, page(r.randint(1, 12))) for i in range(30)]
    rows += [(30, None), (31, ""), (32, " \n\t "), (33, "one two"), (34, "One TWO"), (35, "x"), (36, page(400)), (None, page(6))]
    rows += [(40 + k, base) for k in range(5)] + [(50, base), (50, base), (51, base.upper())]
    near = base.split(" ")
    for k in range(12):
        own = list(near)
        own[3 * k] = f"changed{k}"
        rows.append((60 + k, " ".join(own)))
    rows += [(80 + k, page(3) + "\n" + passage + "\n" + page(3)) for k in range(4)]
    rows += [(90, "a" * 1000), (91, "日本語 テキスト " * 9), (92, "it's <|endoftext|> é Éß 12"), (93, passage), (94, "ab " * 500)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    clash = [(i, t, 0.5, "r", 1, "s", "k", 7) for i, t in corpus()]
    return spark.createDataFrame(clash, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_decontamination(spark, docs, empty):
    texts = dict(corpus())
    items = [(7, texts[36][50:400]), (11, "One,two"), (8, texts[81]), (9, None), (10, "  "), (12, texts[36][50:400])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, row int")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = PLAIN.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    expected, spans = collections.Counter(), {}
    for i, t in corpus():
        w, hit, found = PLAIN.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if items_ := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= items_
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        expected[i, len(w), len(hit), len(found), digest, bool(hit)] += 1
        spans[i] = [x for k, x in enumerate(PLAIN.findall((t or "").translate(LOWER))) if k not in hit]
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    scanned = decontaminate.scan(docs, bench)
    assert got(decontaminate.report(scanned), *columns) == expected
    assert sum(n for k, n in expected.items() if k[-1]) > 4
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and got(clean, "doc_id").total() == sum(n for k, n in expected.items() if not k[-1])
    for r in decontaminate.clean_spans(docs, bench).where("doc_id is not null").collect():
        assert PLAIN.findall((r.text or "").translate(LOWER)) == spans[r.doc_id]
    assert decontaminate.scan(empty, bench).count() == 0
    nothing = decontaminate.report(decontaminate.scan(docs, bench.where("false")))
    assert nothing.where("contaminated").count() == 0 and nothing.count() == docs.count()


def test_items_without_an_id(spark):
    """Their windows hit like any other; as they have no name, no item is counted."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "x y z")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "b c d e f g h i j k"), (5, "x y"), (None, "x y")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.report(decontaminate.scan(docs, items)).collect()}
    assert (rows[1].n_hit, rows[1].n_items, rows[1].contaminated) == (10, 0, True)
    assert rows[1].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert (rows[2].n_hit, rows[2].n_items) == (2, 1) and rows[2].items_sha256 == hashlib.sha256(b"5").hexdigest()


def test_decontamination_in_blocks(docs, monkeypatch):
    whole = got(decontaminate.report(decontaminate.scan(docs, docs.where("doc_id < 3"), item_id="doc_id")), "doc_id", "n_hit")
    monkeypatch.setattr(decontaminate, "MAX_INDEX_WINDOWS", 20)
    assert got(decontaminate.report(decontaminate.scan(docs, docs.where("doc_id < 3"), item_id="doc_id")), "doc_id", "n_hit") == whole


def test_line_dedup(docs, empty):
    key = lambda d: (d[0] is not None, d[0] or 0, d[1] or "")
    rows = {key(d): [(n, x.strip(" \t\r\x0b\x0c")) for n, x in enumerate((d[1] or "").split("\n")) if x.strip(" \t\r\x0b\x0c")] for d in corpus()}
    first = {}
    for k in sorted(rows):
        for i in range(len(rows[k]) - 2):
            first.setdefault(tuple(x for _, x in rows[k][i : i + 3]), (k, i))
    expected = collections.Counter()
    for d in corpus():
        lines, gone = rows[key(d)], set()
        for i in range(len(lines) - 2):
            if first[tuple(x for _, x in lines[i : i + 3])] != (key(d), i):
                gone |= {n for n, _ in lines[i : i + 3]}
        kept = None if d[1] is None else "\n".join(x for n, x in enumerate(d[1].split("\n")) if n not in gone)
        expected[d[0], len(lines), len(gone), kept] += 1
    done = line_dedup.dedup_lines(docs).select("row.doc_id", "n_lines", "n_removed", "kept")
    assert got(done, "doc_id", "n_lines", "n_removed", "kept") == expected
    left = line_dedup.without_repeats(docs)
    assert left.columns == docs.columns
    assert left.count() == sum(n for k, n in expected.items() if not (k[2] and not k[3].strip()))
    assert line_dedup.without_repeats(empty).count() == 0


def test_sharding(docs, empty):
    rows = sharding.shard(docs, shards=7).collect()
    assert len(rows) == len(corpus())
    slots, homes = collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(7))
    by = collections.Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows)
    assert by == collections.Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "bytes", None) for i, t in corpus()
    )
    for r in rows:
        homes[r.size, r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in homes.values())
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_minimax_is_least(seed):
    r = random.Random(seed)
    sizes, shards = [r.randint(1, 30) for _ in range(r.randint(1, 12))], r.randint(1, 5)

    def best(rest, parts):
        if parts == 1:
            return sum(rest)
        return min([max(sum(rest[:k]), best(rest[k:], parts - 1)) for k in range(len(rest) + 1)])

    cuts = sharding.minimax_cuts(sizes, shards)
    parts = [sum(sizes[a:b]) for a, b in zip([0, *cuts], cuts)]
    assert cuts[-1] == len(sizes) and len(cuts) <= shards and max(parts) == best(sizes, shards)


@pytest.mark.parametrize("share", [0.05, 0.1, 0.33, 0.6])
def test_a_hot_atom_leaves_no_shard_empty(share):
    r = random.Random(4)
    sizes = [r.randint(50, 150) for _ in range(4000)]
    rest = sum(sizes)
    hot = int(rest * share / (1 - share))
    sizes.insert(1234, hot)
    cuts = sharding.minimax_cuts(sizes, 40)
    parts = [sum(sizes[a:b]) for a, b in zip([0, *cuts], cuts)]
    assert len(parts) == 40 and max(parts) == hot and parts.count(hot) == 1
    others = [x for x in parts if x != hot]
    assert max(others) < 1.05 * rest / 39 and min(others) > 0.5 * rest / 39


@pytest.mark.parametrize("seed", range(30))
def test_shards_are_empty_only_for_want_of_atoms(seed):
    r = random.Random(seed)
    sizes, shards = [r.choice([1, 2, 3, 60, 90]) for _ in range(r.randint(1, 30))], r.randint(1, 12)
    cuts = sharding.minimax_cuts(sizes, shards)
    assert len(cuts) == min(shards, len(sizes)) and cuts == sorted(set(cuts)) and cuts[-1] == len(sizes)


def test_gapless_rank(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id") % 3).alias("g"), "id")
    ranked = gapless_rank(rows, "g", ["id"]).groupBy("g").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("_rank")).alias("r"))
    assert all(list(r.r) == list(range(r.n)) for r in ranked.collect())


def test_jaccard(docs, empty):
    sets = []
    for i, t in corpus():
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
                up[root(a)] = root(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[root(k)].append(i)
    component = lambda k: min((i for i in least[root(k)] if i is not None), default=None)
    expected = collections.Counter((i, len(s), component(k)) for k, (i, s) in enumerate(sets))
    assert got(jaccard.components(docs), "doc_id", "n_shingles", "component_id") == expected
    kept = jaccard.one_each(docs)
    assert kept.columns == docs.columns
    want = collections.Counter(i for (i, n, c) in expected if n and (i == c or c is None)) + collections.Counter(i for (i, s) in sets if not s)
    assert collections.Counter(r.doc_id for r in kept.collect()) == want
    assert jaccard.components(empty).count() == 0 and jaccard.one_each(empty).count() == 0


def test_one_each_keeps_unrelated_texts_without_an_id_of_their_own(spark):
    line = lambda seed: " ".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz", k=60))
    near = line(1) + " end"
    rows = [(None, line(1)), (None, line(2)), (None, line(2)), (5, line(3)), (5, line(4)), (6, line(4) + " end"), (7, near), (8, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = collections.Counter([(7, near), (None, line(2)), (5, line(3)), (5, line(4)), (8, "")])
    assert got(jaccard.one_each(frame), "doc_id", "text") == want


def test_join_group_finds_all_components():
    r = random.Random(3)
    base = list(range(1000, 1100))
    sets = [(sorted(set(base) - set(r.sample(base, k % 9)) | {k}), 101) for k in range(60)]
    sets += [(sorted(r.sample(range(5000), 80)), 80) for _ in range(40)]
    links = jaccard.join_group([(g, len(g)) for g, _ in sets])
    up = jaccard.Components(len(sets))
    for a, b in links:
        up.up[up.root(a)] = up.root(b)
    own = [set(g) for g, _ in sets]
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                assert up.root(a) == up.root(b)
    assert len(links) == len(sets) - len({up.root(k) for k in range(len(sets))})


def test_connected(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)]
    roots = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(roots[k] == 0 for k in range(41)) and {roots[k] for k in (100, 90, 95)} == {90}


def test_token_ids_equal_the_library():
    vocabulary = packing.default_vocabulary()
    pieces = WordPieces(vocabulary)
    r = random.Random(0)
    signs = ["a", "B", " ", "\n", "\t", " ", "é", "É", "é", "İ", "ß", "Σ", "'s", "'", "'LL", "<|endoftext|>", "1", "9", "#", "中", "\x1c", "\x85", "\r", "😀", "ﬁ", "thing", "×", "ÿ", "quite" * 9]
    texts = ["".join(r.choices(signs, k=r.randint(0, 14))) for _ in range(3000)] + [t or "" for _, t in corpus()]
    ids, counts = pieces.batch(texts)
    ends = np.cumsum(counts)
    for text, stop, n in zip(texts, ends, counts):
        assert ids[stop - n : stop].tolist() == pieces.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(docs, empty):
    tokenizer = WordPieces(packing.default_vocabulary()).tokenizer
    expected = collections.Counter()
    for i, t in corpus():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            expected[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    packed = packing.pack(docs, capacity=64)
    assert got(packed, "doc_id", "piece", "start", "length", "ids_crc32") == expected
    bins = collections.defaultdict(list)
    for r in packed.collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.05 * sum(k[3] * n for k, n in expected.items()) / 64 + 1
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(15))
def test_fullest_bin(seed):
    r = random.Random(seed)
    lengths = [(x, r.randint(1, 3)) for x in sorted(r.sample(range(1, 40), 6), reverse=True)]
    sums = {0}
    for x, n in lengths:
        sums = {s + x * k for s in sums for k in range(n + 1) if s + x * k <= 60}
    chosen = packing.fullest(lengths, 60)
    assert sum(x * n for x, n in chosen) == max(sums) and all(n <= dict(lengths)[x] for x, n in chosen)


def test_substrings(docs, empty):
    starts = collections.Counter()
    for _, t in corpus():
        b = (t or "").encode()
        starts.update(b[k : k + 400] for k in range(len(b) - 399))
    expected = collections.Counter()
    for i, t in corpus():
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, int)
        for k in range(len(b) - 399):
            if starts[b[k : k + 400]] > 1:
                gone[k + 1 : k + 401] = 1
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        expected[i, len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    done = substrings.report(substrings.remove_repeats(docs))
    assert got(done, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected
    assert sum(k[2] > 0 for k in expected) > 15
    assert substrings.remove_repeats(empty).count() == 0


def test_passages_of_every_length(spark):
    """Planted in two or more documents: of 400 bytes or more all are found, under 400 bytes none, whatever their number of words."""
    r = random.Random(21)
    word = lambda: "".join(r.choices("abcdefghijklmnopé", k=r.randint(1, 10)))
    rows, planted = [], {}
    for k in range(160):
        words = r.choice([45, 51, 60, 70, 80, 120])
        passage = f"#{k:03d} " + " ".join(word() for _ in range(words)) + f" {k:03d}#"
        holders = r.choice([2, 2, 3, 6])
        for j in range(holders):
            own = lambda: " ".join(word() for _ in range(r.randint(0, 40)))
            # a sign of its own on either side, so that no repetition reaches further
            rows.append((1000 * k + j, f"{own()} <{j}{passage}{j}> {own()}"))
            planted[1000 * k + j] = len(passage.encode())
    assert min(planted.values()) < 300 and 390 <= sorted(planted.values(), key=lambda n: abs(n - 400))[0] <= 410
    done = substrings.report(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    for x in done.collect():
        n = planted[x.doc_id]
        assert (x.n_removed, x.n_spans) == ((n, 1) if n >= substrings.LENGTH else (0, 0))


def test_substrings_of_a_crowded_anchor(spark, monkeypatch):
    """Passages of less and of more than a window in many surroundings: whole, and no task compares an unbounded collection."""
    r = random.Random(8)
    noise = lambda n: "".join(r.choices("abcdefghij ", k=n))
    short, nearly, wide = noise(200), noise(390), noise(450)
    rows = [noise(500) + short + noise(500) for _ in range(60)] + [noise(500) + nearly + noise(500) for _ in range(40)]
    rows += [noise(500) + wide + noise(500) for _ in range(40)]
    rows += [noise(300) + rows[k][300:900] + noise(300) for k in (0, 1, 2, 60, 61, 100)]
    rows += [noise(40) + rows[70][480:900] + noise(10), rows[3][450:850], rows[4][440:841] + "x", short, wide]
    starts = collections.Counter()
    for t in rows:
        starts.update(t[k : k + 400] for k in range(len(t) - 399))
    expected = collections.Counter()
    for i, t in enumerate(rows):
        gone = {p for k in range(len(t) - 399) if starts[t[k : k + 400]] > 1 for p in range(k, k + 400)}
        kept = "".join(x for p, x in enumerate(t) if p not in gone)
        expected[i, len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    whole = substrings.repeated_windows

    def bounded(contexts, *rest):
        assert len(contexts) < 2 * 8, "too many contexts at a time"
        return whole(contexts, *rest)

    monkeypatch.setattr(substrings, "COLLECTION", 8)
    monkeypatch.setattr(substrings, "repeated_windows", bounded)
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    assert got(substrings.report(substrings.remove_repeats(frame)), "doc_id", "n_removed", "kept_sha256") == expected
    assert sum(k[1] > 0 for k in expected) > 40


def test_rules(docs, empty):
    expected = collections.Counter()
    for i, t in corpus():
        t = t or ""
        w = BLANKLESS.findall(t)
        lines = [x for x in t.split("\n") if BLANKLESS.search(x)]
        c, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                covered |= {k, k + 1, k + 2}
        expected[
            i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w),
        ] += 1
    judged = rules.quality(docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert got(judged, *names) == expected
    assert judged.where("base_failed and kept").count() == 0
    assert rules.quality(empty).count() == 0


def test_votes_separate_good_from_bad():
    patterns = {"+++++++": 800, "+0+++++": 60, "-++++++": 70, "--++++0": 30, "++--+-+": 25, "0000000": 5, "+++++0+": 40}
    model = rules.fit_votes(patterns, 7)
    assert all(model.posterior(p) > 0.9 for p in ("+++++++", "+0+++++", "+++++0+"))
    assert all(model.posterior(p) < 0.5 for p in ("-++++++", "--++++0", "++--+-+"))  # one kind of bad is enough
    # a rule whose bad votes come alone and seldom errs: overruled, but not when several say so
    model = rules.fit_votes(patterns | {"++++-++": 3, "+++++-+": 1}, 7)
    assert model.posterior("++++-++") > 0.5 and model.posterior("+++++-+") > 0.5
    assert all(model.posterior(p) < 0.5 for p in ("-++++++", "--++++0", "++--+-+", "++-0--+", "-+++-++"))
    # where that rule's bad votes are many, they are a kind
    assert rules.fit_votes(patterns | {"++++-++": 60}, 7).posterior("++++-++") < 0.5
    # the counts of a corpus a thousand times as large give the same verdicts
    large = rules.fit_votes({p: 1000 * n for p, n in (patterns | {"++++-++": 3}).items()}, 7)
    assert large.posterior("++++-++") > 0.5 > large.posterior("-++++++")
    assert model.posterior("0000000") == pytest.approx(model.priors[0])
    assert rules.fit_votes({}, 7).priors[0] == 0.85


def test_preference(spark):
    said = [
        (1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (2, 0, "user", None), (2, 1, "assistant", "a"),
        (3, 0, "user", "same"), (3, 1, "assistant", ""), (4, 0, None, "x"), (5, 0, "user", "only chosen"), (None, 0, "user", "z"),
    ]
    other = [
        (1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "no"), (1, 3, "user", "why"), (2, 0, "user", ""), (2, 1, "assistant", "a"),
        (3, 0, "user", "same"), (3, 1, "assistant", ""), (4, 0, None, "x"), (6, 0, "user", "only rejected"),
    ]
    schema = "pair long, turn long, role string, text string"
    frames = [spark.createDataFrame([(*x, 1) for x in rows], schema + ", prompt int") for rows in (said, other)]
    pairs = {r.pair: r for r in preference.preference_pairs(*frames).collect()}
    assert {k: r.prompt_turns for k, r in pairs.items()} == {1: 2, 2: 0, 3: 2, 4: 1}
    one = pairs[1]
    assert one.prompt == "<|system|>\ns\n<|end|>\n<|user|>\nhi\n<|end|>\n"
    assert [one.chosen.text[m.start : m.end] for m in one.chosen.mask] == ["yes\n<|end|>\n"]
    assert one.rejected.text == "<|assistant|>\nno\n<|end|>\n<|user|>\nwhy\n<|end|>\n" and len(one.rejected.mask) == 1
    assert pairs[3].chosen.text == pairs[3].rejected.text == "" and pairs[4].prompt.startswith("<|unknown|>")
    assert preference.preference_pairs(frames[0].where("false"), frames[1]).count() == 0


def test_jaccard_of_pages_with_a_template(spark):
    """Pages that share four fifths of a template do not link; those that share more, or are cut shorter, do."""
    r = random.Random(11)
    own = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    template = own(163)
    rows = [(k, " ".join(template + own(41))) for k in range(120)]
    template = own(163)
    rows += [(200 + k, " ".join(template + own(r.randint(5, 60)))) for k in range(80)]
    rows += [(300 + k, " ".join(template[: r.randint(100, 163)] + own(r.randint(0, 30)))) for k in range(40)]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    want = collections.Counter((i, len(sets[i]), top(i)) for i in sets)
    assert 120 < len({top(i) for i in sets}) < 200
    found = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(jaccard.components(found), "doc_id", "n_shingles", "component_id") == want


@pytest.mark.parametrize("name", ["even", "words", "single", "none"])
def test_every_answered_conversation_gets_a_rejected_side(spark, name):
    ids = {"even": range(0, 80, 2), "words": [f"c{k}" for k in range(9)], "single": [5], "none": []}[name]
    rows = []
    for k, c in enumerate(ids):
        rows += [(c, None, "user", None), (c, 1, "assistant", f"early {k}"), (c, 2, "user", "and"), (c, 3, "assistant", f"last {k}"), (c, 4, "user", "ok")]
    unanswered = {"even": 7, "words": "b"}.get(name)
    if unanswered is not None:
        rows += [(unanswered, 0, "user", "nobody answers"), (unanswered, 0, "user", "nobody answers"), (None, 0, "assistant", "no id")]
        late = {"even": 101, "words": "d"}[name]
        rows += [(late, None, "assistant", None), (late, None, "assistant", ""), (late, 5, None, "tail")]
    kind = "string" if name == "words" else "long"
    turns = spark.createDataFrame([(*r, 1) for r in rows], f"conv_id {kind}, turn long, role string, text string, pair int").repartition(3)
    pairs = {r.pair: r for r in preference.preference_pairs(*preference.swapped_answers(turns)).collect()}
    answered = sorted({c for c, _, role, _ in rows if c is not None and role == "assistant"})
    assert sorted(pairs) == ([] if name == "single" else answered)
    for k, c in enumerate(answered if len(answered) > 1 else []):
        if c not in ids:
            continue
        other = answered[k + 1] if k + 1 < len(answered) else answered[k - 1]
        said = f"last {list(ids).index(other)}" if other in ids else ""
        assert pairs[c].rejected.text == f"<|assistant|>\n{said}\n<|end|>\n" and pairs[c].prompt_turns == 3


def labelled(spark, docs, bad):
    rows = [(i, int(bad(t)), None if i % 17 == 3 else int(bad(t))) for i, t in docs]
    return spark.createDataFrame([*rows, (None, 1, 1), (10**9, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def graded(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choices(["ka", "lo", "mi", "ne", "ra", "tu"], k=r.randint(1, 3)))
    rows = []
    for i in range(900):
        w = [word() for _ in range(r.randint(20, 80))]
        if i % 3 == 0:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["grr", "bah", "fie"])
        if i % 5 == 0:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
    return rows


def test_toxicity(spark, graded, docs, empty):
    frame = spark.createDataFrame(graded, "doc_id long, text string").repartition(4)
    bad = lambda t: bool(re.search("grr|bah|fie", t.lower()))
    labels = labelled(spark, graded, bad)
    rows = toxicity.report(toxicity.score(frame, labels)).collect()
    assert len(rows) == 900 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    texts = dict(graded)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.predicted == bad(texts[r.doc_id]) for r in held) > 0.95 * len(held)
    assert toxicity.score(docs, labels).count() == len(corpus()) and toxicity.score(empty, labels).count() == 0
    assert toxicity.ordinary(frame, labels).columns == ["doc_id", "text"]
    base = {r.score for r in toxicity.score(frame, labels.where("false")).collect()}
    assert len(base) == 1


def test_toxicity_keeps_all_when_nothing_is_known(spark, graded):
    frame = spark.createDataFrame(graded, "doc_id long, text string").repartition(4)
    schema = "doc_id long, toxic int"
    fit = {r.doc_id: r.f for r in frame.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(4)) != 0).alias("f")).collect()}
    free = [i for i, _ in graded if zlib.crc32(str(i).encode()) % 4 != 2]
    held = [i for i, _ in graded if zlib.crc32(str(i).encode()) % 4 == 2]
    toxic = [i for i in free if i % 3 == 0 and fit[i]]
    plain = [i for i in free if i % 3 and fit[i]]
    nothing = [[], [(10**6 + i, i % 2) for i in range(40)], [(i, int(i % 3 == 0)) for i in held], [(toxic[0], 1)], [(i, 0) for i in free]]
    for rows in nothing:
        assert toxicity.ordinary(frame, spark.createDataFrame(rows, schema)).count() == len(graded), rows[:3]
    # a few labels, none of them in the quarter that the curve is fitted on
    few = spark.createDataFrame([(i, 1) for i in toxic[:20]] + [(i, 0) for i in plain[:40]], schema)
    kept = {r.doc_id for r in toxicity.ordinary(frame, few).collect()}
    bad = {i for i, _ in graded if i % 3 == 0}
    assert len(kept & bad) < 0.1 * len(bad) and len(kept - bad) > 0.9 * (len(graded) - len(bad))


def test_votes_equal_plain_cosines():
    """Neighbours, ties and weights by loops over dense vectors."""
    import types

    import pyarrow as pa

    r = np.random.default_rng(2)

    def batch(n):
        # the last is the length term, which every text has
        slots = [[*sorted(r.choice(40, r.integers(0, 9), replace=False).tolist()), 40] for _ in range(n)]
        weights = [r.random(len(x)).astype("float32").tolist() for x in slots]
        return slots, weights

    (slots, weights), (known_slots, known_weights) = batch(700), batch(50)
    for k in range(20, 26):  # copies, so that neighbours tie
        known_slots[k], known_weights[k] = known_slots[20], known_weights[20]
    slots[3], weights[3] = known_slots[20], known_weights[20]
    idf = r.random(quality_votes.SLOTS).astype("float32")
    axes = r.normal(size=(quality_votes.SLOTS, 6)).astype("float32")
    labels = r.integers(0, 2, 50).astype("float32")

    def vector(s, w):
        v = np.zeros(quality_votes.SLOTS)
        for a, b in zip(s, w, strict=True):
            v[a] = b * idf[a]
        v /= max(np.linalg.norm(v), 1e-9)
        v = v @ axes
        return v / max(np.linalg.norm(v), 1e-9)

    arrays = lambda s, w: (pa.array(s, pa.list_(pa.int32())), pa.array(w, pa.list_(pa.float32())))
    taught = quality_votes.latent(quality_votes.dense(*arrays(known_slots, known_weights), idf), axes)
    model = types.SimpleNamespace(value=(idf, axes, taught, labels))
    rows = pa.RecordBatch.from_arrays([pa.array(range(700)), *arrays(slots, weights)], ["doc_id", "slots", "weights"])
    got_ = next(quality_votes.vote(model)(iter([rows]))).column(1).to_numpy()
    plain = np.array([vector(s, w) for s, w in zip(known_slots, known_weights, strict=True)])
    for k in range(700):
        cosine = np.maximum(plain @ vector(slots[k], weights[k]), 1e-6)
        least = np.sort(cosine)[-quality_votes.NEIGHBOURS]
        near = cosine >= least - 1e-7
        strength = cosine[near] ** quality_votes.SHARPNESS
        assert got_[k] == pytest.approx((strength * labels[near]).sum() / strength.sum(), abs=2e-3)
    # whole shapes: what differs in the tail only is a different term
    long = "a1" * 9
    assert quality_votes.shape(long + "!") != quality_votes.shape(long + "?") and quality_votes.shape("Abc,12") == "Aa,0"


def test_quality_votes(spark, graded, docs, empty):
    frame = spark.createDataFrame(graded, "doc_id long, text string").repartition(4)
    labels = labelled(spark, graded, lambda t: not t.isupper())
    rows = quality_votes.report(quality_votes.score(frame, labels)).collect()
    texts = dict(graded)
    held = [r for r in rows if r.held_out]
    assert len(rows) == 900 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == (not texts[r.doc_id].isupper()) for r in held) > 0.97 * len(held)
    assert quality_votes.score(docs, labels).count() == len(corpus()) and quality_votes.score(empty, labels).count() == 0
    assert {r.score for r in quality_votes.score(frame, labels.where("false")).collect()} == {0.5}


def test_jaccard_bounds_its_batches_and_what_a_group_holds(spark, monkeypatch):
    """op7: batches of at most 2,000 rows, the caller's setting afterwards; of a group only hubs are held as Python sets."""
    rows, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    inner = jaccard.class_roots
    monkeypatch.setattr(jaccard, "class_roots", lambda sets: seen.append(spark.conf.get(rows)) or inner(sets))
    before = spark.conf.get(rows)
    docs = spark.createDataFrame([(i, "a b c d e f g h " + "xy"[i % 2]) for i in range(4)], "doc_id long, text string")
    assert jaccard.components(docs).count() == 4
    assert 0 < int(seen[0]) <= 2_000 and spark.conf.get(rows) == before

    common = np.arange(10**15, 10**15 + 490)
    sets = [(np.concatenate((np.arange(10) + 10 * k, common)), 500) for k in range(2_000)]
    tracemalloc.start()
    links = jaccard.join_group(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(links) == 1_999
    assert peak < 30e6
