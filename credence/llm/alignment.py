"""Alignment of the tokens of two tokenizers over the same bytes, by diagonal run skipping.

Both tokenizers cut the same bytes, so a text is two ascending arrays of byte offsets where tokens end. Offsets that
both have cut the tokens into groups. Most groups are one token on either side, in long stretches: there the arrays agree
at the present *shift* between the two indices. Exponential probing compares stretches of 1, 2, 4, ... entries at that
shift and, past the first that differs, halves again, so an agreeing stretch costs a few comparisons. Where
the arrays part, the irregular group is resolved step by step up to the next common end, and the shift becomes what it is
there. Every step inside a group is one link, a pair of tokens whose byte ranges overlap.

How often an id of one tokenizer is linked with one of the other is counted over the corpus: once in the
row, then with partial sums in each map task. The counts go back to the documents. Of all pairs the ``HEAVY`` most
frequent at most are broadcast, which is nearly all occurrences, hot pairs first of all; what is rarer is joined by
a shuffle.

Defined cases: texts that are null, empty, or not given back byte by byte by both tokenizers have no tokens: all numbers are 0, the
digest is ''. Special strings inside a text are plain text. Repeated rows are counted each and get equal rows;
an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.arrays import part_slices, text_slices
from credence.llm.common import row_key
from credence.llm.token_counts import byte_letters
from credence.session import stage

#: Id pairs whose counts are sent to all executors, at most (17 bytes each).
HEAVY = 1_000_000
#: Characters of text that are tokenised at a time; longer texts are taken in parts, cut where both tokenizers cut.
SLICE = 1_000_000
#: Pre-tokens of byte-level vocabularies (a fixed value of their format).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters are cut alike by every edition of Unicode.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7E\xA0-ɏͰ-ͳΆ-ϿЀ-ԯ‐-‧‰-›€]*")
WORDS = re.compile(r"(?<=\S) ")
#: Words whose ids a task keeps before it starts anew.
KNOWN = 300_000
SPACE = "▁"


class ByteTokens:
    """Ids of a byte-level BPE vocabulary and the bytes of each.

    Plain text goes through ``tiktoken`` with the same merges as ranks, which is several times as
    fast; any other through ``tokenizers``. Both give the same ids.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        with open(vocabulary, encoding="utf-8") as f:
            told = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        special = {t["id"] for t in told["added_tokens"]}
        ranks = {bytes(back[c] for c in s): k for s, k in told["model"]["vocab"].items() if k not in special}
        self.bytes = [b""] * (max([*ranks.values(), *special]) + 1)
        for token, k in ranks.items():
            self.bytes[k] = token
        self.sizes = np.fromiter(map(len, self.bytes), np.int64)
        # ranks stand for merges only where ids were dealt in their order
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        made = [told["model"]["vocab"][a + b] for a, b in merges]
        self.fast = None
        if made == sorted(made) and told["pre_tokenizer"].get("type") == "ByteLevel" and not told.get("normalizer"):
            self.fast = tiktoken.Encoding("aligned", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        self.vocabulary, self.library = vocabulary, None

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.fast.encode_ordinary(text), np.int64)

    def __call__(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.vocabulary)
            self.library.encode_special_tokens = True  # their strings are plain text
        return self.library.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Ids of a sentencepiece model and the bytes of each."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.library.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)
        ]
        self.sizes = np.fromiter(map(len, self.bytes), np.int64)
        #: Whether no piece reaches from a word into the blanks behind it, and blanks stay as they are.
        self.parts = not any(x != SPACE and y == SPACE for p in pieces for x, y in zip(p, p[1:], strict=False)) and (
            b"".join(self.bytes[k] for k in self.library.encode("  a  b  ")) == b"   a  b  "
        )

    def batch(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class BothTokens:
    """Ids of both tokenizers for many texts, and whether each gives the bytes of a text back.

    In plain text neither tokenizer has a token that goes on from a word into the blanks behind it, so such texts are
    encoded word by word, each with the blank before it. The ids of the words that a task has met are kept side by side in one array a
    tokenizer, and the ids of a text are gathered from there.
    """

    def __init__(self, byte_vocabulary: str, piece_model: str):
        self.first, self.second = ByteTokens(byte_vocabulary), PieceTokens(piece_model)
        self.by_word = self.first.fast is not None and self.second.parts
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int64)] * 2
        self.upto = [np.zeros(1, np.int64)] * 2
        self.exact = np.zeros(0, bool)

    def learn(self, words: list[str]) -> None:
        """All new words are encoded by the first tokenizer as one text and cut apart by their bytes, but for words
        that end in a blank and would run into the next."""
        words = [w for w in words if not w[-1].isspace()] + [w for w in words if w[-1].isspace()]
        raw = [b" " + w.encode() for w in words]
        ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
        tight = sum(not w[-1].isspace() for w in words)
        parts = [self.first.plain(b"".join(raw[:tight]).decode()), *(self.first.plain(x.decode()) for x in raw[tight:])]
        pieces = self.second.batch(words)  # the model adds the blank itself
        exact = np.ones(len(words), bool)
        ids = np.concatenate(parts), np.fromiter(chain.from_iterable(pieces), np.int64)
        upto = np.searchsorted(np.cumsum(self.first.sizes[ids[0]]), ends) + 1, np.cumsum([len(x) for x in pieces], dtype=np.int64)
        whole = b"".join(raw)
        for k, names in enumerate((self.first.bytes, self.second.bytes)):
            sizes = np.cumsum((self.first.sizes, self.second.sizes)[k][ids[k]])
            if not np.array_equal(sizes[upto[k] - 1], ends) or b"".join(map(names.__getitem__, ids[k].tolist())) != whole:
                bounds = zip([0, *upto[k].tolist()], upto[k].tolist(), strict=False)
                exact &= [b"".join(map(names.__getitem__, ids[k][i:j].tolist())) == x for (i, j), x in zip(bounds, raw, strict=True)]
            self.upto[k] = np.concatenate((self.upto[k], len(self.flat[k]) + upto[k]))
            self.flat[k] = np.concatenate((self.flat[k], ids[k]))
        self.exact = np.concatenate((self.exact, exact))
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))

    def _gather(self, words: np.ndarray, k: int) -> np.ndarray:
        start = self.upto[k][words]
        size = self.upto[k][words + 1] - start
        ends = np.cumsum(size)
        return self.flat[k][np.arange(ends[-1]) + np.repeat(start - ends + size, size)]

    def _whole(self, text: str, b: list[int]) -> tuple[np.ndarray, np.ndarray, bool]:
        a, raw = self.first(" " + text) if text else [], b" " + text.encode()
        same = [b"".join(map(t.bytes.__getitem__, ids)) == raw for t, ids in ((self.first, a), (self.second, b))]
        return np.array(a, np.int64), np.array(b, np.int64), all(same)

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        cut = [words_of(text) if self.by_word and text and PLAIN.fullmatch(text) else None for text in texts]
        if len(self.words) > KNOWN:
            self.forget()
        self.learn(list({w for words in cut if words for w in words if w not in self.words}))
        whole = iter(self.second.batch([t for t, words in zip(texts, cut, strict=True) if words is None]))
        for text, words in zip(texts, cut, strict=True):
            if words is None:
                yield self._whole(text, next(whole))
            else:
                at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
                yield self._gather(at, 0), self._gather(at, 1), bool(self.exact[at].all())


def words_of(text: str) -> list[str]:
    """The text cut at blanks that follow another sign, without those blanks; no part is empty."""
    words = WORDS.split(text)
    if len(words) > 1 and not words[-1]:
        words[-2:] = [words[-2] + " "]
    return words


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links as indices (a, b), and the indices of the last tokens (a, b) of each group.

    Both arrays ascend and end with the same offset.
    """
    n, i, shift = len(ends_a), 0, 0
    # stretches are compared as the bytes of 64-bit numbers
    raw_a, raw_b, at_a, at_b = ends_a.tobytes(), ends_b.tobytes(), ends_a.tolist(), ends_b.tolist()
    runs: list[int] = []  # start and length of each stretch of one-to-one groups, and its shift
    odd_a: list[int] = []
    odd_b: list[int] = []
    last_a: list[int] = []
    last_b: list[int] = []
    while i < n:
        if at_a[i] == at_b[i + shift]:
            start, step, move = i, 8, 8 * shift
            low = 8 * i + 8
            # ahead as long as they agree; a slice past the end of one array only is shorter than the other and differs
            while (there := raw_a[low : low + step]) == raw_b[low + move : low + move + step] and there:
                low += len(there)
                step *= 2
            while step > 8:  # back by halves to the first that differs
                step //= 2
                if (there := raw_a[low : low + step]) == raw_b[low + move : low + move + step]:
                    low += len(there)
            i = low // 8
            runs += (start, i - start, shift)
            continue
        j = i + shift
        x, y = at_a[i], at_b[j]
        while True:
            odd_a.append(i)
            odd_b.append(j)
            if x < y:
                i += 1
                x = at_a[i]
            elif y < x:
                j += 1
                y = at_b[j]
            else:
                break
        last_a.append(i)
        last_b.append(j)
        i += 1
        shift = j + 1 - i  # what the group has moved it to
    start, size, moved = np.array(runs, np.int64).reshape(-1, 3).T
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    one_a = np.repeat(start, size) + inside
    one_b = one_a + np.repeat(moved, size)
    join = lambda x, y: np.concatenate((x, np.array(y, np.int64)))
    end_a = join(one_a, last_a)
    order = np.argsort(end_a, kind="stable")
    return join(one_a, odd_a), join(one_b, odd_b), end_a[order], join(one_b, last_b)[order]


class GroupText:
    """The groups of a text written out: ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a = n_a
        words = [f"{k}{mark}" for k in range(n_a) for mark in ",|"] + [f"{k}{mark}" for k in range(n_b) for mark in ",;"]
        self.words = np.array(words, object)

    def __call__(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> str:
        size_a, size_b = np.diff(end_a, prepend=-1), np.diff(end_b, prepend=-1)
        words = np.empty(len(a) + len(b), np.int64)
        words[np.arange(len(a)) + np.repeat(end_b + 1 - size_b, size_a)] = 2 * a
        words[np.arange(len(b)) + np.repeat(end_a + 1, size_b)] = 2 * (self.n_a + b)
        words[end_a + end_b + 1 - size_b] += 1
        words[end_a + end_b + 1] += 1
        return "".join(self.words[words].tolist())[:-1]


class Part(NamedTuple):
    """The alignment of a text, or of a part of one that begins and ends where both tokenizers cut."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: str
    pairs: np.ndarray
    times: np.ndarray


def _joined(parts: list[Part | None]) -> tuple:
    """Numbers, digest and linked pairs of a text; nothing if a part of it has no alignment."""
    if None in parts:
        return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32)
    digest = hashlib.sha256(";".join(p.groups for p in parts).encode()).hexdigest()
    pairs, times = parts[0].pairs, parts[0].times
    if len(parts) > 1:
        pairs, place = np.unique(np.concatenate([p.pairs for p in parts]), return_inverse=True)
        times = np.bincount(place, np.concatenate([p.times for p in parts])).astype(np.int64)
    return *(sum(p[k] for p in parts) for k in range(4)), digest, pairs, times


def _wholes(texts: list[str]) -> Iterator[tuple[list[tuple[int, bool]], list[str]]]:
    for part in text_slices(texts, SLICE):
        yield [(k, True) for k in range(part.start, part.stop)], texts[part]


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligning(byte_vocabulary: str, piece_model: str):
    """A mapInArrow function from (_id, _th, text) to (_id, _th) and ``ALIGNED``; a pair is ``a * 2**24 + b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = BothTokens(byte_vocabulary, piece_model)
        first, second = both.first, both.second
        written = GroupText(len(first.bytes), len(second.bytes))

        def of(text: str, a: np.ndarray, b: np.ndarray, exact: bool) -> Part | None:
            if not exact:
                return None
            link_a, link_b, end_a, end_b = align(np.cumsum(first.sizes[a]), np.cumsum(second.sizes[b]))
            pairs, times = np.unique(a[link_a] << 24 | b[link_b], return_counts=True)
            return Part(len(a), len(b), len(end_a), len(link_a), written(a, b, end_a, end_b), pairs, times)

        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            held: list[Part | None] = []  # parts of a text that went before
            before = None
            for marks, parts in part_slices(texts, SLICE) if both.by_word else _wholes(texts):
                owner, rows = [], []
                # both put a blank before what they get; all but the first part of a text begin with theirs
                earlier = [before, *(k for k, _ in marks)]
                parts = [p[1:] if k == e else p for (k, _), e, p in zip(marks, earlier, parts, strict=False)]
                before = earlier[-1]
                for (k, last), text, ids in zip(marks, parts, both(parts), strict=True):
                    held.append(of(text, *ids) if text else None)
                    if last:
                        owner.append(k)
                        rows.append(_joined(held))
                        held = []
                if not rows:
                    continue
                *plain, pairs, times = zip(*rows, strict=True)
                offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), kind))
                    for x, kind in ((pairs, pa.int64()), (times, pa.int32()))
                ]
                kinds = [pa.int64()] * 4 + [pa.string()]
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in (0, 1)), *[pa.array(c, k) for c, k in zip(plain, kinds, strict=True)], *lists],
                    ["_id", "_th", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return run


def aligned(docs: DataFrame, byte_vocabulary: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: sizes, digest of the groups, and how often each pair of ids is linked in it."""
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["_id"].dataType.simpleString()
    return texts.mapInArrow(aligning(byte_vocabulary, piece_model), f"_id {kind}, _th long, {ALIGNED}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how often ids are linked in the corpus; ``best`` where no pair with the same second id is more frequent."""
    linked = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = stage(linked.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n")), "linked-pairs")
    second = F.col("pair").bitwiseAND(F.lit(2**24 - 1))
    most = counts.groupBy(second.alias("b")).agg(F.max("n").alias("most"))  # at most a vocabulary
    found = counts.join(F.broadcast(most), second == F.col("b"))
    return stage(found.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def heavy_from(counts: DataFrame, at_most: int) -> int:
    """The least count from which on at most ``at_most`` pairs are left, by steps of an eighth of a power of two."""
    step = F.floor(8 * F.log2("n"))
    sizes = counts.groupBy(step.cast("long").alias("step")).agg(F.count("*").alias("n"), F.min("n").alias("least")).collect()
    total, least = 0, None
    for row in sorted(sizes, reverse=True):  # some hundreds at any size
        total += row["n"]
        if total > at_most:
            return least if least is not None else 2**62
        least = row["least"]
    return 0


def looking_up(known):
    """A mapInArrow function that replaces pairs and times by their sums, and lists the pairs it does not know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = known.value
        for batch in batches:
            lists, times = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).flatten().to_numpy()
            asked = lists.flatten().to_numpy()
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            by_row = lambda x: np.concatenate((np.zeros(1, np.int64), np.cumsum(x, dtype=np.int64)))[bounds]
            at = np.minimum(np.searchsorted(pairs, asked), max(0, len(pairs) - 1))
            there = pairs[at] == asked if len(pairs) else np.zeros(len(asked), bool)
            total = by_row(np.where(there, times * counts[at], 0)) if len(pairs) else by_row(asked * 0)
            top = by_row(np.where(there & best[at], times, 0)) if len(pairs) else by_row(asked * 0)
            offsets = pa.array(by_row(~there), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-2], pa.array(np.diff(top)), pa.array(np.diff(total)),
                    pa.ListArray.from_arrays(offsets, pa.array(asked[~there], pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(times[~there], pa.int32())),
                ],
                [*batch.schema.names[:-2], "n_best", "count_sum", "pairs", "times"],
            )

    return run


def score_links(rows: DataFrame, counts: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``rows`` (staged) with ``n_best`` and ``count_sum`` in place of pairs and times."""
    spark = rows.sparkSession
    least = heavy_from(counts, heavy)
    table = counts.where(F.col("n") >= least).toArrow().to_pydict()
    pairs = np.array(table["pair"], np.int64)
    order = np.argsort(pairs)
    known = (pairs[order], np.array(table["n"], np.int64)[order], np.array(table["best"], bool)[order])
    names = rows.columns[:-2]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]]
    schema = ", ".join([*kinds, "n_best long, count_sum long, pairs array<long>, times array<int>"])
    found = rows.mapInArrow(looking_up(spark.sparkContext.broadcast(known)), schema)
    if least == 0:
        return found.drop("pairs", "times")
    found = stage(found, "links-scored")
    # rows equal in id and text hold the same pairs: one of them asks for all
    asking = found.where(F.size("pairs") > 0).groupBy("_id", "_th").agg(F.first("pairs").alias("pairs"), F.first("times").alias("times"))
    rare = asking.select("_id", "_th", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "_id", "_th", F.col("x.pairs").alias("pair"), F.col("x.times").alias("k")
    )
    sums = rare.join(counts.where(F.col("n") < least), "pair").groupBy(F.col("_id").alias("r_id"), F.col("_th").alias("r_th")).agg(
        F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more_sum")
    )
    both = found.join(sums, F.col("_id").eqNullSafe(F.col("r_id")) & (F.col("_th") == F.col("r_th")), "left")
    return both.select(
        *names, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align_tokenizers(
    docs: DataFrame, vocabularies: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY
) -> tuple[DataFrame, DataFrame]:
    """What each document's alignment is worth, and the corpus-wide table of linked ids (pair, n, best)."""
    rows = stage(aligned(docs, *(vocabularies or default_vocabularies()), id_col, text_col), "aligned-tokens")
    counts = pair_counts(rows)
    return score_links(rows, counts, heavy), counts


def report(scored: DataFrame) -> DataFrame:
    return scored.select(
        F.col("_id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
