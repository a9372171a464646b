"""Array arithmetic on the bytes of many texts at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_WORD_END = re.compile(r"\S(?= )")
_BASE = 0x9E3779B97F4A7C15
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all others (one to one)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class RunHashes:
    """64-bit hashes of stretches of an array, from running sums of a polynomial in an odd base."""

    def __init__(self):
        self.powers = [np.ones(1, np.uint64)] * 2

    def __call__(self, values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of ``values[start:stop]`` for all starts and stops; ``values`` are above 0."""
        with np.errstate(over="ignore"):
            if len(self.powers[0]) <= len(values):
                steps = np.full((2, 2 * len(values) + 1), np.uint64(_BASE), np.uint64)
                steps[1], steps[:, 0] = np.uint64(pow(_BASE, -1, 2**64)), 1
                self.powers = list(np.multiply.accumulate(steps, axis=1))
            up, down = self.powers
            total = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values * up[: len(values)], out=total[1:])
            return (total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * _LENGTH


def word_parts(text: str, size: int) -> list[str]:
    """A text in parts of about ``size`` characters, cut before blanks that follow a word; without such blanks it stays whole."""
    parts, start = [], 0
    while len(text) - start > size:
        at = text.rfind(" ", start + 1, start + size)
        while at > start and text[at - 1].isspace():
            at = text.rfind(" ", start + 1, at)
        if at <= start:  # a word longer than a part
            at = next((m.start() + 1 for m in _WORD_END.finditer(text, start + size)), len(text))
        parts.append(text[start:at])
        start = at
    if start < len(text) or not parts:
        parts.append(text[start:])
    if len(parts) > 1 and parts[-1].isspace():  # no part of blanks alone
        parts[-2:] = [parts[-2] + parts[-1]]
    return parts


def text_slices(texts: list[str], size: int) -> Iterator[slice]:
    """Neighbouring texts of at most ``size`` characters together; a longer text is a slice of its own."""
    start = total = 0
    for k, text in enumerate(texts):
        if k > start and total + len(text) > size:
            yield slice(start, k)
            start, total = k, 0
        total += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def part_slices(texts: list[str], size: int) -> Iterator[tuple[list[tuple[int, bool]], list[str]]]:
    """Texts in bounded portions: for each part of a portion the number of its text and whether the text ends with it, and the parts."""
    marks, parts = [], []
    for k, text in enumerate(texts):
        cut = word_parts(text, size)
        marks += [(k, at == len(cut)) for at in range(1, len(cut) + 1)]
        parts += cut
    for part in text_slices(parts, size):
        yield marks[part], parts[part]
