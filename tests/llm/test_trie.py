"""The prefix trie against dictionaries of prefixes."""

import collections
import hashlib
import random
import zlib

import pytest

from credence.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, pos int, key string"


def talks():
    r = random.Random(9)
    said = lambda: r.choice(["yes", "no", "né", "", None, "a longer answer"])
    rows = []
    for c in [*range(40), 100, 101, 104, 207, 333, -5, -3, 2**40]:
        for t in range(r.choice([1, 2, 3, 5, 12])):
            rows.append((c, t, r.choice(["user", "assistant", None, ""]), said()))
    rows += [(c, t, "user", "the same") for c in range(500, 560) for t in range(4)]
    rows += [(600, None, "user", "first"), (600, 0, "user", "second"), (600, 0, "user", "second"), (None, 0, "user", "nobody")]
    rows += [(701, t, "user", f"turn {t}") for t in range(300)] + [(702, t, "user", f"turn {t}") for t in range(300)]
    return rows


def brute(sequences):
    """Nodes of {conversation: list of (role, text)}."""
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c, turns in sorted(sequences.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, who in members.items():
        own = (len(who) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += children[p] == 0
    return collections.Counter(
        (
            min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest(),
        )
        for p, who in members.items()
    )


def plain(rows):
    found = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            found[c].append((t is not None, t or 0, digest, role, text))
    return {c: [x[3:] for x in sorted(turns)] for c, turns in found.items()}


def rebuilt(rows):
    own = plain(rows)
    share = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: share[c]] + own[c][share[c] :] for c in own}


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(*x, 1, 2, "k") for x in talks()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def got(nodes):
    return collections.Counter(tuple(r) for r in nodes.collect())


def test_trie_of_conversations_as_they_are(turns):
    rows = prefix_trie.with_ends(prefix_trie.turn_rows(turns))
    want = brute(plain(talks()))
    assert got(prefix_trie.trie(rows)) == want


def test_trie_of_rebuilt_conversations(turns, monkeypatch):
    want = brute(rebuilt(talks()))
    assert any(k[1] == 0 and k[2] is None for k in want)
    rows = prefix_trie.turn_rows(turns)
    assert got(prefix_trie.report(prefix_trie.trie(prefix_trie.shared_heads(rows)))) == want
    monkeypatch.setattr(prefix_trie, "TOGETHER", 3)  # lists in many parts
    assert got(prefix_trie.trie(prefix_trie.shared_heads(rows))) == want


def test_few_and_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(prefix_trie.shared_heads(prefix_trie.turn_rows(empty))).collect() == []
    assert prefix_trie.trie(prefix_trie.with_ends(prefix_trie.turn_rows(empty))).collect() == []
    # the only turn of conversation 3 is replaced by those of conversation 0, which is not there
    one = spark.createDataFrame([("3", 1, "user", "hello"), ("x", 1, "user", "no number")], "conv_id string, turn int, role string, text string")
    assert zlib.crc32(b"3") % 9 > 0
    nodes = prefix_trie.trie(prefix_trie.shared_heads(prefix_trie.turn_rows(one)))
    assert got(nodes) == brute({3: []})
    assert got(prefix_trie.trie(prefix_trie.with_ends(prefix_trie.turn_rows(one)))) == brute({3: [("user", "hello")]})
