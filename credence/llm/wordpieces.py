"""Token ids of many texts at once, as the ``tokenizers`` library gives them.

Prose repeats its words, so each batch of texts is cut into its units (runs of letters,
runs of signs, single digits: the vocabulary's own splitting rule) with array operations, the distinct
units are merged to tokens once, and the ids are laid out again in text order. Units
outside plain Latin text (apostrophes, other scripts, combining marks, control signs) are
handed to the library chunk by chunk, so every text gets exactly the library's ids.
"""

from __future__ import annotations

import json
import os

import numpy as np

from credence.llm.arrays import RunHashes

#: What a vocabulary must say of itself to be cut by array operations (fixed values of its file format).
NORMALIZER = ["NFC", "Replace", "Lowercase"]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
WIDEST = 32
BLOCK = 500_000
BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)
FAR = np.int32(2**30)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    for i in range(33, 127):
        kinds[i] = LETTER if chr(i).isalpha() else DIGIT if chr(i).isdigit() else SIGN
    kinds[[ord("'"), ord("<")]] = OTHER  # contractions and special tokens
    kinds[[32, 9, 10, 13]] = BLANK
    return kinds


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class WordPieces:
    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            told = json.load(f)
        steps = [x["type"] for x in (told.get("normalizer") or {}).get("normalizers", [])]
        cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.plain = steps == NORMALIZER and cuts[0].get("pattern") == {"Regex": SPLITTER} and (
            told["model"].get("end_of_word_suffix") == WORD_END
        )
        if not self.plain:
            return
        vocab, merges = told["model"]["vocab"], [x if isinstance(x, list) else x.split(" ") for x in told["model"]["merges"]]
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + WORD_END] for c in letters], np.int32)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = left << 20 | right
        # open addressing: a quarter full at most, so nearly every pair is found or refuted at once
        self.bits = (4 * len(keys)).bit_length()
        self.keys, self.order = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, FAR, np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.order[slot] = key, rank
        self.kinds = _byte_classes()
        self.hashes = RunHashes()
        self.pairs = None
        if max(self.inner.max(), self.last.max()) < 512:
            grid = np.arange(512, dtype=np.int32)
            self.pairs = self._ranks(np.repeat(grid, 512), np.tile(grid, 512)).reshape(512, 512)

    def _first_ranks(self, ids: np.ndarray) -> np.ndarray:
        if self.pairs is None:
            return self._ranks(ids[:, :-1], ids[:, 1:])
        found = self.pairs[ids[:, :-1], ids[:, 1:]]  # -1 wraps around; such pairs are blanked out
        found[(ids[:, 1:] < 0)] = FAR
        return found

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a.astype(np.int64) << 20 | b
        wanted[(a < 0) | (b < 0)] = -2
        slot = self._slots(wanted)
        there = self.keys[slot]
        ranks = np.where(there == wanted, self.order[slot], FAR)
        left = np.flatnonzero((there != wanted) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            hit = there == wanted[left]
            ranks[left[hit]] = self.order[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return ranks

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _merge(self, units: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units (rows of bytes), padded with -1, and how many each has."""
        width = units.shape[1]
        rows = np.arange(len(units))
        ids = np.where(np.arange(width) < lengths[:, None], self.inner[units], -1).astype(np.int32)
        ids[rows, lengths - 1] = self.last[units[rows, lengths - 1]]
        out = ids.copy()
        ranks = self._first_ranks(ids)
        cols = np.arange(width)
        while len(rows):
            j = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), j]
            on = best < FAR
            out[rows[~on]] = ids[~on]
            rows, ids, ranks, j, best = rows[on], ids[on], ranks[on], j[on], best[on]
            if not len(rows):
                break
            n = np.arange(len(rows))
            ids[n, j] = self.merged[best]
            source = np.minimum(cols + (cols > j[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, 1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, source[:, :-1].clip(max=width - 2), 1)
            ranks[:, -1] = FAR
            before = np.maximum(j - 1, 0)
            ranks[n, before] = np.where(j > 0, self._ranks(ids[n, before], ids[n, j]), ranks[n, before])
            after = np.minimum(j, width - 2)
            ranks[n, after] = self._ranks(ids[n, after], ids[n, after + 1])
        return out, (out >= 0).sum(1)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and the number of ids of each."""
        if not self.plain:
            found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            counts = np.array([len(x) for x in found], np.int64)
            return np.fromiter((i for x in found for i in x), np.uint32, counts.sum()), counts
        raw = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        parts, at, since = [], 0, 0
        for k, end in enumerate(ends):  # blocks that fit the processor's cache
            if end - since >= BLOCK or k == len(raw) - 1:
                data = np.frombuffer(b"".join(raw[at : k + 1]), np.uint8)
                low, start, stop, odd = self._units(data)
                names = self._names(data, low, start, stop, odd)
                parts.append((data, low, start + since, (stop - start).astype(np.int32), odd, names))
                at, since = k + 1, end
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data, low, start, n, odd, names = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(names)
        ordered = names[order]
        new = np.concatenate((np.ones(min(1, len(names)), bool), ordered[1:] != ordered[:-1]))
        firsts, inverse = order[new], np.empty(len(names), np.int32)
        inverse[order] = np.cumsum(new, dtype=np.int32) - 1
        counts, flat, offsets = self._encode(data, low, start[firsts], n[firsts], odd[firsts])
        sizes = counts[inverse]
        before = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        at = np.arange(before[-1])
        at += np.repeat(offsets[inverse] - before[:-1], sizes)
        by_text = before[np.searchsorted(start, ends)]
        return flat[at], np.diff(by_text, prepend=0)

    def _units(self, data: np.ndarray):
        """Lower-cased bytes, unit bounds, and which units the library must cut."""
        kinds = self.kinds[data]
        low = data + np.uint8(32) * ((data >= 65) & (data <= 90))
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = data[lead + 1]
        latin = lead[(after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)]
        kinds[latin] = kinds[latin + 1] = LETTER
        upper = latin[(data[latin + 1] <= 0x9E)] + 1
        low[upper] += 0x20
        gap = np.flatnonzero(kinds == BLANK)
        change = np.empty(len(data), bool)
        change[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=change[1:])
        change[1:] |= kinds[1:] == DIGIT
        change[gap] = False
        strange = np.flatnonzero(kinds == OTHER)
        if not len(strange):
            start = np.flatnonzero(change)
            odd = np.zeros(len(start), bool)
        else:  # a chunk between blanks that holds a strange byte stays whole
            ends = np.unique(np.searchsorted(gap, strange))
            head = np.where(ends > 0, gap[ends - 1] + 1, 0)
            change[self._spread(head, gap[ends], len(data))] = False
            change[head] = True
            start = np.flatnonzero(change)
            odd = np.isin(start, head)
        follows = np.concatenate((start[1:], [len(data)]))
        stop = np.minimum(follows, gap[np.searchsorted(gap, start)]) if len(start) else start
        return low, start, stop, odd | (stop - start > WIDEST)

    def _names(self, data, low, start, stop, odd) -> np.ndarray:
        """A 64-bit hash of each unit's bytes, as written where the library will cut it."""
        shown = low.astype(np.uint64) + np.uint64(1)
        if odd.any():
            raw = self._spread(start[odd], stop[odd], len(data))
            shown[raw] = data[raw].astype(np.uint64) + np.uint64(301)
        return self.hashes(shown, start, stop)

    def _encode(self, data, low, start, n, odd):
        """How many ids each unit has, all ids, and where those of each unit begin."""
        pieces, where = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        counts = np.zeros(len(start), np.int64)
        for low_n, high_n in ((0, 4), (4, 8), (8, 12), (12, 16), (16, WIDEST)):
            own = np.flatnonzero(~odd & (n > low_n) & (n <= high_n))
            if len(own):
                rows = low[np.minimum(start[own, None] + np.arange(high_n), len(low) - 1)]
                ids, counts[own] = self._merge(rows, n[own])
                pieces.append(ids[ids >= 0].astype(np.uint32))
                where.append(own)
        own = np.flatnonzero(odd)
        if len(own):
            chunks = [data[a : a + k].tobytes().decode("utf-8", "surrogatepass") for a, k in zip(start[own], n[own], strict=True)]
            found = [e.ids for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]
            counts[own] = [len(x) for x in found]
            pieces.append(np.fromiter((i for x in found for i in x), np.uint32, counts[own].sum()))
            where.append(own)
        placed = np.concatenate(where)
        offsets = np.zeros(len(start), np.int64)
        offsets[placed] = np.cumsum(counts[placed]) - counts[placed]
        return counts, np.concatenate(pieces), offsets

    @staticmethod
    def _spread(start, stop, size) -> np.ndarray:
        """Bytes inside the given disjoint ranges."""
        steps = np.zeros(size + 1, np.int8)
        steps[start] += 1
        steps[stop] -= 1
        return np.cumsum(steps[:-1], dtype=np.int8) > 0
