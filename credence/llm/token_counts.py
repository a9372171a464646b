"""Token counts of whole texts by rank-synchronous merging of ragged arrays.

A byte-pair tokenizer cuts a text into pre-tokens and merges the symbols of each, lowest rank first. Here the
pre-tokens of many texts lie side by side in one flat array of symbols with the bounds of each (ragged rows). A round
looks up the rank of every neighbouring pair, takes the least rank of each row, and applies that pair in all rows
at once; rows without a mergeable pair are done. The symbols that survive are the tokens.

A pair that stands several times in a row is merged at all its places in one round. That equals merging them one by one
as long as no merge builds on a later one, which is checked when the vocabulary is read; otherwise only the
leftmost place is merged in a round.

Words repeat, so a task keeps the counts of those it has seen, about ``KNOWN`` of them, and cuts and merges the others.
Texts are taken ``SLICE`` characters at a time, long ones in parts.

Defined cases: a null text counts as empty: 0 bytes, 0 tokens. Special strings inside a text are one token each, as the
library reads them. Every row gets a row, repeated ones and null ids too; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.arrays import part_slices

LIMIT = 2048
NAMES = ["doc_id", "n_bytes", "n_tokens"]
#: Characters of text that a task holds as words at a time; longer texts are taken in parts, cut between words.
SLICE = 2_000_000
#: Words whose counts a task keeps before it starts anew.
KNOWN = 400_000
FAR = np.int32(2**31 - 1)
#: What a vocabulary file says when texts may be cut here (fixed values of its format).
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of these characters are cut here, all others by the library: no composition, no
#: letter that depends on its neighbours or on the edition of Unicode.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7E\xA0-ɏ‐-‧‰-›€]*")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class RankMerger:
    """Merges many pre-tokens at once, by the tables of a vocabulary file."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-pair vocabularies have ranked merges")
        self.vocabulary, self.library = vocabulary, None
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        self.to_bytes = {ord(c): b for b, c in enumerate(letters)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = left << 32 | right
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        made = np.full(max(vocab.values()) + 1, -1, np.int64)  # the first merge that makes a symbol
        made[self.merged[::-1]] = np.arange(len(merges))[::-1]
        self.ordered = bool(np.all(np.maximum(made[left], made[right]) < np.arange(len(merges)))) and (
            len(np.unique(self.merged)) == len(merges)
        )
        special = [t for t in told["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in special):
            raise ValueError("special strings that depend on what stands beside them are not supported")
        names = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        own = cuts[0].get("pattern") == {"Regex": SPLITTER} and cuts[0].get("invert") and cuts[0].get("behavior") == "Removed"
        self.plain = told.get("normalizer") == NORMALIZER and bool(own) and len(cuts) == 2 and not cuts[1].get("use_regex")
        self.cut = regex.compile(SPLITTER).findall

    def _ranks(self, symbols: np.ndarray) -> np.ndarray:
        """Rank of each symbol with the next one, rows left aside."""
        wanted = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], FAR)

    def survivors(self, rows: list[bytes]) -> np.ndarray:
        """How many symbols are left of each row (none of them empty) when nothing can be merged."""
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        if not len(rows):
            return counts
        data = np.frombuffer(b"".join(rows), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(counts)
        symbols[ends - 1] = self.last[data[ends - 1]]
        live, sizes = np.arange(len(rows)), counts.copy()
        while len(live):
            starts = np.cumsum(sizes) - sizes
            ranks = np.full(len(symbols), FAR, np.int32)
            ranks[:-1] = self._ranks(symbols)
            ranks[starts + sizes - 1] = FAR  # the last of a row has no partner
            least = np.minimum.reduceat(ranks, starts)
            on = least < FAR
            counts[live[~on]] = sizes[~on]
            if not on.all():
                kept = np.repeat(on, sizes)
                symbols, ranks = symbols[kept], ranks[kept]
                live, sizes, least = live[on], sizes[on], least[on]
                if not len(live):
                    break
                starts = np.cumsum(sizes) - sizes
            hit = np.flatnonzero(ranks == np.repeat(least, sizes))
            row = np.searchsorted(starts, hit, "right") - 1
            if self.ordered:  # of places that overlap, as in "aaa", every other one from the left
                new = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
                run = np.flatnonzero(new)
                hit_no = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
                hit, row = hit[hit_no % 2 == 0], row[hit_no % 2 == 0]
            else:
                first = np.concatenate(([True], row[1:] != row[:-1]))
                hit, row = hit[first], row[first]
            symbols[hit] = self.merged[ranks[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols = symbols[keep]
            sizes = sizes - np.bincount(row, minlength=len(live))
        return counts

    def words(self, text: str) -> tuple[list, int]:
        """The text in parts that no pre-token crosses, and how many special strings it holds. A part is a string between
        blanks, still to be cut, or the bytes of a pre-token that the library has cut."""
        parts = self.special.split(text) if self.special else [text]
        found: list = []
        for part in parts:
            if self.plain and PLAIN.fullmatch(part):
                found += part.lower().split()
            elif part:
                found += self._library_cuts(part)
        return found, len(parts) - 1

    def tokens_of(self, words: list) -> list[int]:
        """Number of tokens of each word, as ``words`` gives them."""
        cut = [[w] if isinstance(w, bytes) else [x.encode() for x in self.cut(w)] for w in words]
        rows = [x for found in cut for x in found]
        upto = np.concatenate(([0], np.cumsum(self.survivors(rows))))
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in cut], dtype=np.int64)))
        return np.diff(upto[bounds]).tolist()

    def _library_cuts(self, part: str) -> list[bytes]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.vocabulary)
        if self.library.normalizer:
            part = self.library.normalizer.normalize_str(part)
        cuts = self.library.pre_tokenizer.pre_tokenize_str(part)
        return [word.translate(self.to_bytes).encode("latin-1") for word, _ in cuts if word]


def counting(vocabulary: str):
    """A mapInArrow function from (doc_id, text) to (doc_id, n_bytes, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, known = RankMerger(vocabulary), {}
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n_tokens = np.zeros(len(texts), np.int64)
            for marks, parts in part_slices(texts, SLICE):
                cut = [merger.words(part) for part in parts]
                if len(known) > KNOWN:
                    known = {}
                new = list({w for words, _ in cut for w in words if w not in known})
                known.update(zip(new, merger.tokens_of(new), strict=True))
                for (k, _), (words, special) in zip(marks, cut, strict=True):
                    n_tokens[k] += sum(map(known.__getitem__, words)) + special
            n_bytes = [len(text) if text.isascii() else len(text.encode()) for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens)], NAMES)

    return run


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; row-local, no shuffle."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    counted = plain.mapInArrow(counting(vocabulary or default_vocabulary()), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
