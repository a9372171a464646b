"""Similarity join of word n-gram sets over prefix trees.

A document's set holds its distinct ``WORDS``-word shingles; two documents link when
``100 * |both| >= 75 * |either|``. Wanted is the connected component of every document.

1. One pass over the texts makes the sets (sorted 64-bit hashes) and a digest of each; equal sets are one class from here on.
2. A link needs ``k`` common shingles among the ``n - ceil(0.75 n) + k`` smallest of either side. Classes whose smallest
   shingles are not shared often enough with any other class cannot link and leave; that is nearly every unique text.
   Counting sends 16 bytes a shingle, and a shingle held by many documents of a batch is sent once.
3. The sets of those left are made again, shingles held by one class only are struck out, and classes with fewer than three
   quarters of their shingles left leave. Each shingle now has its exact number of holders, which gives the global order: rare first.
4. In a few rounds classes meet those with the same smallest shingle under a permutation. Each group is joined over a
   prefix tree: sets in the global order share the paths of common prefixes, partial overlaps are counted once a path, and subtrees are pruned
   when the remaining lengths cannot reach the needed overlap, or when they hold only the searcher's own component. This links nearly all that links, and
   makes one component of a large group of near copies without comparing all its pairs.
5. What is left is exact: any further link shares one of the rarest ``|shared| - ceil(0.75 n) + 1`` shingles of either side. What stands
   behind a shingle bounds the size of a partner; a set meets only sets in the bands of sizes that it can link with, and of two
   one must be able to link with a set as large as itself. So pages that share most of a template, but not enough, do not meet at all. Pairs of
   *different* components that meet, and that neither the place of the shared shingle nor a bit map of both sets rules out,
   are checked by their whole sets.

No step drops a candidate by count. Only classes, links and roots move after step 1, never pairs of copies.

Defined cases: null, empty and blank texts have no set, link with nothing and are their own component. A text of fewer than ``WORDS``
words has its whole sequence as one shingle. Repeated rows share class and component. A null id stays null and never names a component. Extra columns pass through or are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.arrays import RunHashes, mixed
from credence.llm.common import connected, row_key, text_or_empty
from credence.session import arrow_rows, stage

WORDS = 5
#: Least similarity as a fraction: a link has 100 * |both| >= 75 * |either|.
PART, WHOLE = 75, 100
#: One shingle in so many (and one) is asked for in common among the smallest.
SLACK = 20
ROUNDS = 4
#: Sets with the most links that a set tries before it walks the tree.
TRIED = 4
MAP_BITS = 1024
#: Sets meet in step 5 by shingle and by size, in bands of this ratio.
BAND = 1.1
#: Shingles that one task compares at a time.
BUCKET = 1_000_000
#: Digests a task remembers so as not to send a copy's shingles twice.
SEEN = 200_000
BLOCK = 500_000
#: Rows of an Arrow batch, at most: executor and worker each hold a batch of texts, a worker some ten arrays of its shingles as well.
BATCH_ROWS = 2_000
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def least_overlap(n: int) -> int:
    """Common shingles a set of ``n`` needs for any link."""
    return -(-PART * n // WHOLE)


def pair_overlap(a: int, b: int) -> int:
    """Common shingles that sets of ``a`` and ``b`` need: part * (a + b) / (whole + part), rounded up."""
    return -(-PART * (a + b) // (WHOLE + PART))


def _asked(n: int) -> int:
    return 1 + n // SLACK


class Shingles:
    """Sets of the texts of a batch, by array operations on all their bytes."""

    def __init__(self, words: int = WORDS):
        self.words, self.hashes = words, RunHashes()

    def of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        raw, size = [], 0
        for text in texts:
            raw.append((text or "").encode("utf-8", "replace").lower() + b"\n")
            size += len(raw[-1])
            if size >= BLOCK:
                yield from self._block(raw)
                raw, size = [], 0
        if raw:
            yield from self._block(raw)

    def _block(self, raw: list[bytes]) -> Iterator[np.ndarray]:
        data = np.frombuffer(b"".join(raw), np.uint8)
        blank = _BLANK[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate(([0], edge))
        start, stop = edge[0::2], edge[1::2]
        names = mixed(self.hashes(data.astype(np.uint64) + np.uint64(1), start, stop))
        bounds = np.searchsorted(start, np.cumsum([0] + [len(r) for r in raw]))
        with np.errstate(over="ignore"):
            grams = names[: max(0, len(names) - self.words + 1)].copy()
            for k in range(1, self.words):
                grams = mixed(grams * _STEP + names[k : len(names) - self.words + 1 + k])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a >= self.words:
                    yield np.unique(grams[a : b - self.words + 1])
                elif b > a:
                    h = names[a : a + 1] + np.uint64(b - a)
                    for k in range(a + 1, b):
                        h = mixed(h * _STEP + names[k : k + 1])
                    yield h
                else:
                    yield np.zeros(0, np.uint64)


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names)


def make_sets(whole: bool):
    """A mapInArrow function from (_id, _th, text) to (_id, _th, n, sid, grams).

    ``grams`` are the smallest shingles (or, if ``whole``, all), once per class and task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen = Shingles(), set()
        for batch in batches:
            sizes, sids, grams = [], [], []
            for s in sets.of(batch.column(2).to_pylist()):
                n = len(s)
                sid = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None
                sizes.append(n)
                sids.append(sid)
                if sid is None or sid in seen:
                    grams.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(sid)
                grams.append(s.tobytes() if whole else s[: n - least_overlap(n) + _asked(n)].tobytes())
            yield _batch(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sids, pa.binary()), pa.array(grams, pa.binary())],
                ["_id", "_th", "n", "sid", "grams"],
            )

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 64-bit numbers of a column of byte strings, and the row of each."""
    values = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
    sizes = [len(v) for v in values]
    return (np.concatenate(values) if values else np.zeros(0, np.uint64)), np.repeat(np.arange(len(sizes)), sizes)


def deal(buckets: int):
    """(sid, grams) to (bucket, grams, owners): 16 bytes a shingle, dealt out by its value.

    ``owners`` are the first eight bytes of the digests. A shingle that two classes of the batch hold goes out once without
    an owner, and its holders get their count at once: a row without a bucket's shingles, (owner, count) instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, row = _flat(batch.column(1))
            if not len(grams):
                continue
            names = np.array([int.from_bytes(x.as_py()[:8], "little") for x in batch.column(0)], np.uint64)
            order = np.argsort(grams, kind="stable")
            g, r = grams[order], row[order]
            twin = np.zeros(len(g), bool)
            same = (g[1:] == g[:-1]) & (names[r[1:]] != names[r[:-1]])
            twin[1:] |= same
            twin[:-1] |= same
            repeat = np.zeros(len(g), bool)
            repeat[1:] = (g[1:] == g[:-1])
            # whole runs of a shared shingle are settled here
            run_id = np.cumsum(~repeat) - 1
            shared_run = np.zeros(run_id[-1] + 1, bool)
            shared_run[run_id[twin]] = True
            shared = shared_run[run_id]
            counts = np.bincount(r[shared], minlength=batch.num_rows)
            has = np.flatnonzero(counts)
            send = ~repeat
            owner = np.where(shared, np.uint64(0), names[r])
            out_g, out_o = g[send], owner[send]
            bucket = (out_g % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((out_o, bucket))
            out_g, out_o, bucket = out_g[by], out_o[by], bucket[by]
            used, own = _runs(bucket)
            cols = [
                pa.array(used, pa.int64()),
                pa.array([out_g[x].tobytes() for x in own], pa.binary()),
                pa.array([out_o[x].tobytes() for x in own], pa.binary()),
                pa.array([None] * len(used), pa.binary()), pa.array([None] * len(used), pa.binary()),
            ]
            yield _batch(cols, ["bucket", "grams", "owners", "done", "counts"])
            if len(has):
                yield _batch(
                    [
                        pa.array([int(names[has[0]] % np.uint64(buckets))], pa.int64()), pa.array([None], pa.binary()),
                        pa.array([None], pa.binary()), pa.array([names[has].tobytes()], pa.binary()),
                        pa.array([counts[has].astype(np.int64).tobytes()], pa.binary()),
                    ],
                    ["bucket", "grams", "owners", "done", "counts"],
                )

    return run


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """The different values of an ascending array and where each stands; the work is that of the array, whatever the values."""
    used, first = np.unique(ordered, return_index=True)
    ends = np.append(first[1:], len(ordered)).tolist()
    return used, [slice(a, b) for a, b in zip(first.tolist(), ends, strict=True)]


def count_shared(homes: int):
    """One bucket to (home, owners, counts): how many of a class's shingles another class holds as well,
    packed by the home of the class so that rows do not grow with classes times buckets."""

    def run(table: pa.Table) -> pa.Table:
        owners, shared = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for done, counts in zip(table["done"], table["counts"], strict=True):
            if done.as_py() is not None:
                owners.append(np.frombuffer(done.as_buffer(), np.uint64))
                shared.append(np.frombuffer(counts.as_buffer(), np.int64))
        sent = table.filter(table["grams"].is_valid()).combine_chunks()
        if sent.num_rows:
            g = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in sent["grams"]])
            o = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in sent["owners"]])
            order = np.lexsort((o, g))
            g, o = g[order], o[order]
            again = np.concatenate(([False], (g[1:] == g[:-1]) & (o[1:] == o[:-1])))
            g, o = g[~again], o[~again]
            run_ = np.cumsum(np.concatenate(([True], g[1:] != g[:-1]))) - 1
            # two owners, or the mark (0) of a batch that settled its own holders
            known = (np.bincount(run_)[run_] > 1) & (o != 0)
            names, counts = np.unique(o[known], return_counts=True)
            owners.append(names)
            shared.append(counts.astype(np.int64))
        owner, count = np.concatenate(owners), np.concatenate(shared)
        home = (mixed(owner) % np.uint64(homes)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        owner, count = owner[order], count[order]
        used, own = _runs(home[order])
        return pa.table({
            "home": pa.array(used, pa.int64()),
            "owners": pa.array([owner[x].tobytes() for x in own], pa.binary()),
            "counts": pa.array([count[x].tobytes() for x in own], pa.binary()),
        })

    return run


def sum_shared(table: pa.Table) -> pa.Table:
    """One home to (owner, shared)."""
    owners = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table["owners"]])
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table["counts"]])
    names, inverse = np.unique(owners, return_inverse=True)
    return pa.table({"owner": pa.array(names), "shared": pa.array(np.bincount(inverse, counts, len(names)).astype(np.int64))})


def _pack(home: np.ndarray, homes: int, sids: list[bytes], sizes: np.ndarray, row: np.ndarray, *values: np.ndarray):
    """(home, sids, sizes, lengths, values...) blobs of the rows' values, by the home of each value; for sorted ``row``."""
    order = np.lexsort((row, home))
    home, row, values = home[order], row[order], [v[order] for v in values]
    out = []
    for h, own in zip(*_runs(home), strict=True):
        held, lengths = np.unique(row[own], return_counts=True)
        blobs = [b"".join(sids[k] for k in held), sizes[held].astype(np.int64).tobytes(), lengths.astype(np.int64).tobytes()]
        out.append((int(h), *blobs, *[v[own].tobytes() for v in values]))
    return out


def _unpack(table: pa.Table, *columns: str):
    """Distinct classes with their sizes, and the row and values of each shingle, in the order of rows."""
    number: dict[bytes, int] = {}
    sizes: list[int] = []
    rows, values = [], {c: [] for c in columns}
    for r in table.to_pylist():
        own = [r["sids"][k : k + 16] for k in range(0, len(r["sids"]), 16)]
        for sid, n in zip(own, np.frombuffer(r["sizes"], np.int64).tolist(), strict=True):
            if sid not in number:
                number[sid] = len(number)
                sizes.append(n)
        rows.append(np.repeat(np.array([number[x] for x in own]), np.frombuffer(r["lengths"], np.int64)))
        for c in columns:
            values[c].append(np.frombuffer(r[c], np.uint64))
    row = np.concatenate(rows)
    found = [np.concatenate(values[c]) for c in columns]
    order = np.lexsort((found[0], row))  # a class may come from two tasks: its shingles count once
    row, found = row[order], [v[order] for v in found]
    fresh = np.concatenate(([True], (found[0][1:] != found[0][:-1]) | (row[1:] != row[:-1])))
    return list(number), np.array(sizes), row[fresh], [v[fresh] for v in found]


def deal_whole(buckets: int):
    """(sid, n, grams) to the parts of whole sets that fall into each bucket of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, row = _flat(batch.column(2))
            out = _pack(
                (grams % np.uint64(buckets)).astype(np.int64), buckets, batch.column(0).to_pylist(),
                batch.column(1).to_numpy(), row, grams,
            )
            yield from _blobs(out, ["bucket", "sids", "sizes", "lengths", "grams"])

    return run


def _blobs(out: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    if out:
        first, *rest = zip(*out, strict=True)
        yield _batch([pa.array(first, pa.int64()), *[pa.array(c, pa.binary()) for c in rest]], names)


def rank_shared(homes: int):
    """One bucket to its shingles that two classes hold or more, with the number of holders, by the home of the class."""

    def run(table: pa.Table) -> pa.Table:
        sids, sizes, row, (grams,) = _unpack(table, "grams")
        _, inverse, holders = np.unique(grams, return_inverse=True, return_counts=True)
        holders = holders[inverse]
        keep = holders > 1
        names = np.array([int.from_bytes(x[8:], "little") for x in sids], np.uint64) % np.uint64(homes)
        row = row[keep]
        out = _pack(names.astype(np.int64)[row], homes, sids, sizes, row, grams[keep], holders[keep].astype(np.uint64))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int64()] + [pa.binary()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["home", "sids", "sizes", "lengths", "grams", "holders"])

    return run


def assemble(table: pa.Table) -> pa.Table:
    """One home to (sid, n, grams): shared shingles, rare first; classes with too few of them leave."""
    sids, sizes, row, (grams, holders) = _unpack(table, "grams", "holders")
    order = np.lexsort((grams, holders, row))
    grams, cuts = grams[order], np.searchsorted(row, np.arange(len(sids) + 1))
    able = [k for k in range(len(sids)) if cuts[k + 1] - cuts[k] >= least_overlap(int(sizes[k]))]
    return pa.table({
        "sid": pa.array([sids[k] for k in able], pa.binary()), "n": pa.array([int(sizes[k]) for k in able], pa.int64()),
        "grams": pa.array([grams[cuts[k] : cuts[k + 1]].tobytes() for k in able], pa.binary()),
    })


class Components:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x


class PrefixTree:
    """Sets in the global order; a node holds a stretch of shingles that all sets below it share."""

    __slots__ = ("run", "below", "ends", "least", "longest", "rest", "owner")

    def __init__(self, run: list[int]):
        self.run, self.below, self.ends = run, {}, []
        self.least, self.longest, self.rest, self.owner = 1 << 60, 0, 0, None

    def add(self, grams: list[int], n: int, name: int, owners: Components) -> None:
        node, at = self, 0
        while True:
            node.note(n, len(grams) - at, name, owners)
            if at == len(grams):
                node.ends.append(name)
                return
            child = node.below.get(grams[at])
            if child is None:
                leaf = PrefixTree(grams[at:])
                leaf.note(n, 0, name, owners)
                leaf.ends.append(name)
                node.below[grams[at]] = leaf
                return
            k, run = 1, child.run
            top = min(len(run), len(grams) - at)
            while k < top and run[k] == grams[at + k]:
                k += 1
            if k < len(run):  # part the stretch
                upper = PrefixTree(run[:k])
                upper.least, upper.longest, upper.owner = child.least, child.longest, child.owner
                upper.rest = child.rest + len(run) - k
                child.run = run[k:]
                upper.below[child.run[0]] = child
                node.below[grams[at]] = child = upper
            node, at = child, at + k

    def note(self, n: int, rest: int, name: int, owners: Components) -> None:
        self.least, self.longest = min(self.least, n), max(self.longest, n)
        self.rest = max(self.rest, rest)
        if self.owner is None:
            self.owner = name
        elif self.owner >= 0 and owners.root(self.owner) != owners.root(name):
            self.owner = -1


def join_group(sets: list[tuple[list[int] | np.ndarray, int]]) -> list[tuple[int, int]]:
    """Links (later, earlier) that connect what is similar in a group of (ordered grams, n).

    The sets with the most in common come first, so the hub of a large group is in the tree early, and each set
    tries the greatest hubs before it walks the tree. Only the set at hand and the hubs are held as Python sets, and
    a shingle is one object in all paths of the tree.
    """
    found: list[tuple[int, int]] = []
    owners = Components(len(sets))
    tree = PrefixTree([])
    order = sorted(range(len(sets)), key=lambda k: (sets[k][1] - len(sets[k][0]), -sets[k][1], k))
    same: dict[int, int] = {}
    listed = lambda k: [same.setdefault(g, g) for g in np.asarray(sets[k][0]).tolist()]
    own: dict[int, frozenset[int]] = {}  # of the hubs
    hubs: dict[int, int] = {}  # set: how many came to it

    def merge(a: int, b: int) -> None:
        found.append((a, b))
        owners.up[owners.root(a)] = owners.root(b)
        hubs[b] = hubs.get(b, 0) + 1

    for x in order:
        grams, n = listed(x), sets[x][1]
        place = {g: i for i, g in enumerate(grams)}
        greatest = sorted(hubs, key=hubs.get, reverse=True)[:TRIED]
        own = {h: own.get(h) or frozenset(listed(h)) for h in greatest}
        for h in greatest:
            if owners.root(x) != owners.root(h) and len(own[h].intersection(place)) >= pair_overlap(n, sets[h][1]):
                merge(x, h)
        stack = [(tree, 0, 0)]
        while stack:
            node, both, passed = stack.pop()
            if node.owner is None or (node.owner >= 0 and owners.root(node.owner) == owners.root(x)):
                continue  # nothing, or only the searcher's own component, below
            if PART * n > WHOLE * node.longest or PART * node.least > WHOLE * n:
                continue
            need = pair_overlap(n, max(node.least, least_overlap(n)))
            spare = both + len(node.run) + node.rest - need  # shingles of this path that may be missing
            for g in node.run:
                i = place.get(g)
                if i is not None:
                    both += 1
                    passed = i + 1
                elif spare:
                    spare -= 1
                else:
                    spare = -1
                    break
            if spare < 0:
                continue
            if both + min(len(grams) - passed, node.rest) < need:
                continue
            for y in node.ends:
                if owners.root(y) != owners.root(x) and both >= pair_overlap(n, sets[y][1]):
                    merge(x, y)
            stack.extend((child, both, passed) for child in node.below.values())
        tree.add(grams, n, x, owners)
    return found


def meet(round_: int):
    """(sid, n, grams) to (key, ...): the smallest shingle under the round's permutation."""
    turn = np.uint64(round_ * int(_STEP) % 2**64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for grams in batch.column(2):
                g = np.frombuffer(grams.as_buffer(), np.uint64)
                keys.append(int(mixed(g + turn).min().view(np.int64)) if len(g) else None)
            yield _batch([pa.array(keys, pa.int64()), *batch.columns], ["key", *batch.schema.names])

    return run


def join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to links (a, b). Groups end at the next key; a group is taken in stretches of ``GROUP`` sets,
    of which the hubs go on to the next stretch."""

    def links(rows: list) -> tuple[list[tuple[bytes, bytes]], list]:
        found = join_group([(np.frombuffer(g, np.uint64), n) for _, _, n, g in rows])
        hubs = sorted({b for _, b in found})[:GROUP // 4]
        return [(rows[a][1], rows[b][1]) for a, b in found], [rows[k] for k in hubs]

    held: list = []
    for batch in batches:
        out: list = []
        cols = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("key", "sid", "n", "grams")]
        for row in zip(*cols, strict=True):
            if held and held[-1][0] != row[0]:
                out += links(held)[0] if len(held) > 1 else []
                held = []
            held.append(row)
            if len(held) >= GROUP:
                more, held = links(held)
                out += more
        yield _links(out)
    yield _links(links(held)[0] if len(held) > 1 else [])


#: Sets of one group that a task joins at a time in the rounds; step 5 finds what lies in different stretches.
GROUP = 4_000


def _links(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return _batch([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])


def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, n, grams) to (gram, sid, n, rest) of the shingles one of which any link of the class shares;
    ``rest`` shingles come after it in the order."""
    for batch in batches:
        sid, n = batch.column(0), batch.column(1).to_pylist()
        parts = [np.frombuffer(g.as_buffer(), np.int64) for g in batch.column(2)]
        whole = [len(p) for p in parts]
        parts = [p[: len(p) - least_overlap(k) + 1] for p, k in zip(parts, n, strict=True)]
        row = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
        rest = [np.arange(w - 1, w - 1 - len(p), -1) for w, p in zip(whole, parts, strict=True)]
        yield _batch(
            [
                pa.array(np.concatenate(parts) if parts else [], pa.int64()), sid.take(row), batch.column(1).take(row),
                pa.array(np.concatenate(rest) if rest else [], pa.int64()),
            ],
            ["gram", "sid", "n", "rest"],
        )


def bit_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, n, grams) to (sid, held, bits): ``MAP_BITS`` bits, each set by the shingles that hash to it."""
    for batch in batches:
        maps, held = [], []
        for grams in batch.column(2):
            g = np.frombuffer(grams.as_buffer(), np.uint64)
            bits = np.zeros(MAP_BITS, np.uint8)
            bits[(mixed(g) % np.uint64(MAP_BITS)).astype(np.int64)] = 1
            maps.append(np.packbits(bits).view(np.int64).tolist())
            held.append(len(g))
        yield _batch([batch.column(0), pa.array(held, pa.int64()), pa.array(maps, pa.list_(pa.int64()))], ["sid", "held", "bits"])


def check_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for a, b, an, bn, ag, bg in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            both = len(np.intersect1d(np.frombuffer(ag, np.uint64), np.frombuffer(bg, np.uint64), assume_unique=True))
            if both >= pair_overlap(an, bn):
                found.append((a, b))
        yield _links(found)


SETS = "_id {id}, _th long, n long, sid binary, grams binary"


def classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Staged (_id, _th, n, sid, grams) of every row, and the keyed texts."""
    keyed = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    kind = keyed.schema["_id"].dataType.simpleString()
    return stage(keyed.mapInArrow(make_sets(False), SETS.format(id=kind)), "gram-sets"), keyed


def possible(made: DataFrame) -> DataFrame:
    """(sid) of the classes that share enough of their smallest shingles with others (step 2)."""
    sent = made.where("grams is not null").select("sid", "grams")
    total = sent.agg(F.sum(F.octet_length("grams")) / 8).first()[0] or 0
    buckets = max(1, int(total // BUCKET) + 1)
    dealt = sent.mapInArrow(deal(buckets), "bucket long, grams binary, owners binary, done binary, counts binary")
    shared = (
        dealt.groupBy("bucket").applyInArrow(count_shared(buckets), "home long, owners binary, counts binary")
        .groupBy("home").applyInArrow(sum_shared, "owner long, shared long")
    )
    own = made.where("grams is not null").select("sid", "n").distinct()
    least = F.lit(1) + F.floor(F.ceil(F.lit(PART) * F.col("n") / WHOLE) / SLACK)
    named = own.mapInArrow(name_owner, "sid binary, n long, owner long")
    return named.join(shared, "owner").where(F.col("shared") >= least).select("sid", "n")


def name_owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner = [int.from_bytes(x[:8], "little", signed=True) for x in batch.column(0).to_pylist()]
        yield _batch([*batch.columns, pa.array(owner, pa.int64())], ["sid", "n", "owner"])


def ordered_sets(made: DataFrame, keyed: DataFrame, able: DataFrame) -> DataFrame:
    """(sid, n, grams) of the classes that may link, in the global order (step 3)."""
    kind = keyed.schema["_id"].dataType.simpleString()
    chosen = (
        made.join(able.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("_id", "_th")).alias("k"))
        .select(F.col("k._id").alias("k_id"), F.col("k._th").alias("k_th"))
    )
    texts = keyed.join(chosen, keyed["_id"].eqNullSafe(chosen["k_id"]) & (keyed["_th"] == chosen["k_th"]), "left_semi")
    whole = texts.mapInArrow(make_sets(True), SETS.format(id=kind)).where("grams is not null")
    whole = stage(whole.select("sid", "n", "grams"), "whole-sets")
    total = whole.agg(F.sum("n")).first()[0] or 0
    buckets = int(total // BUCKET) + 1
    blobs = "sids binary, sizes binary, lengths binary, grams binary"
    ranked = (
        whole.mapInArrow(deal_whole(buckets), f"bucket long, {blobs}")
        .groupBy("bucket").applyInArrow(rank_shared(buckets), f"home long, {blobs}, holders binary")
    )
    return stage(ranked.groupBy("home").applyInArrow(assemble, "sid binary, n long, grams binary"), "ordered-sets")


def class_roots(sets: DataFrame) -> DataFrame:
    """(node, root) of the classes that link with others (steps 4 and 5)."""
    open_, links = sets.select("sid", "n", "grams"), None
    for k in range(ROUNDS):
        keyed = open_.mapInArrow(meet(k), "key long, sid binary, n long, grams binary").where("key is not null")
        grouped = keyed.repartition("key").sortWithinPartitions("key")
        found = stage(grouped.mapInArrow(join_groups, "a binary, b binary"), f"links-{k}")
        links = links.unionByName(found) if k else found
        if k < ROUNDS - 1:  # what has come to a hub is stood for by it
            open_ = stage(open_.join(found.select(F.col("a").alias("sid")), "sid", "left_anti"), f"open-{k}")
    comps = connected(links, "rounds")
    rare = sets.select("sid", "n", "grams").mapInArrow(rarest, "gram long, sid binary, n long, rest long")
    rare = stage(
        rare.join(comps, F.col("sid") == F.col("node"), "left").select("gram", "sid", "n", "rest", F.coalesce("root", "sid").alias("comp")),
        "rarest",
    )
    mixed_ = rare.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram")
    open_ = rare.join(mixed_, "gram")
    maps = sets.select("sid", "n", "grams").mapInArrow(bit_maps, "sid binary, held long, bits array<long>")
    open_ = stage(open_.join(maps, "sid"), "open-grams")
    # the sizes a class can link with by what follows a shingle: no set above ``most`` reaches the overlap any more
    most = F.floor((WHOLE + PART) * (F.col("rest") + 1) / PART).cast("long") - F.col("n")
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(BAND))
    larger = open_.where(most >= F.ceil(PART * F.col("n") / WHOLE)).withColumn(
        "band", F.explode(F.sequence(band(F.ceil(PART * F.col("n") / WHOLE)), band(F.least("n", most))))
    )
    smaller = open_.where(most >= F.col("n")).withColumn("band", band(F.col("n")))
    left, right = smaller.alias("l"), larger.alias("r")
    need = F.ceil(PART * (F.col("l.n") + F.col("r.n")) / (WHOLE + PART))
    # at the first shingle that a pair shares, what comes after it must still make up the needed overlap
    reach = F.least("l.rest", "r.rest") + 1 >= need
    # every bit in which two maps differ stands for a shingle that only one set holds
    differ = F.aggregate(F.zip_with("l.bits", "r.bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    close = differ <= F.col("l.held") + F.col("r.held") - 2 * need
    meets = (F.col("l.gram") == F.col("r.gram")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.comp") != F.col("r.comp"))
    ordered = (F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.sid") < F.col("r.sid")))
    pairs = left.join(right, meets & ordered & reach & close).select(F.col("l.sid").alias("a"), F.col("r.sid").alias("b")).distinct()
    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("an"), F.col("grams").alias("ag"))
    two = sets.select(F.col("sid").alias("b"), F.col("n").alias("bn"), F.col("grams").alias("bg"))
    sure = pairs.join(one, "a").join(two, "b").select("a", "b", "an", "bn", "ag", "bg").mapInArrow(check_pairs, "a binary, b binary")
    sure = stage(sure, "checked-links")
    return comps if sure.isEmpty() else connected(links.unionByName(sure), "classes")


def rooted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _th, n_shingles, component_id, top) of every row. ``top`` names the component even where ids are
    null or stand for several texts; it is null without words."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):  # all that runs in Python is staged here
        made, keyed = classes(docs, id_col, text_col)
        able = stage(possible(made), "able-classes")
        sets = ordered_sets(made, keyed, able)
        roots = class_roots(sets)
    least = made.where("sid is not null").groupBy("sid").agg(F.min("_id").alias("least"))
    named = least.join(roots, least["sid"] == roots["node"], "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    tops = named.where("root <> sid").select("root", "least").unionByName(named.where("root = sid").select("root", "least"))
    tops = tops.groupBy(F.col("root").alias("top")).agg(F.min("least").alias("component"))
    of_class = stage(
        named.join(tops, named["root"] == tops["top"]).select(F.col("sid").alias("class"), "component", "top"), "class-components"
    )
    rows = made.select("_id", "_th", "n", "sid")
    return rows.join(of_class, rows["sid"] == of_class["class"], "left").select(
        F.col("_id").alias("doc_id"), "_th", F.col("n").alias("n_shingles"),
        F.coalesce("component", "_id").alias("component_id"), "top",
    )


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _th, n_shingles, component_id) of every row."""
    return rooted(docs, id_col, text_col).drop("top")


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with one document of each component: the one with the smallest id, or any where all ids are null.

    Of repeated rows with that id one stays, chosen by the digest of the text. Texts that are not similar stay apart
    also where they share an id or have none. Documents without words all stay.
    """
    found = rooted(docs, id_col, text_col)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    first = found.where("n_shingles > 0").groupBy("top").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")).alias("k")
    ).select(name("k.doc_id").alias("_name"), F.col("k._th").alias("_digest"))
    rows = docs.select(F.struct("*").alias("row"), name(id_col).alias("_name"), F.xxhash64(text_or_empty(text_col)).alias("_digest"))
    # the join has dealt rows out by these columns, so dropping repeated rows moves nothing again
    kept = rows.join(first, ["_name", "_digest"], "left_semi").dropDuplicates(["_name", "_digest"]).select("row.*")
    blank = docs.where(~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.unionByName(blank)
