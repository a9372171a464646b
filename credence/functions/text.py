"""Text expressions with Python string semantics, as Spark columns.

Java's ``\\s``, ``\\w`` and ``\\b`` are ASCII only, so the classes are spelled out.
Counting is done by shrinking the string (``regexp_replace`` + ``char_length``):
``regexp_count`` builds an array holding every match.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------
WS_CLASS = (
    r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD_CLASS = r"\p{L}\p{N}_"
TAG_PATTERN = r"<[^>]+>"
ZERO_WIDTH_PATTERN = r"[\u200b\u200c\u200d\ufeff]"
URL_PATTERN = rf"https?://[^{WS_CLASS}]+|www\.[^{WS_CLASS}]+"
SENTENCE_END = r"[.!?]+"
DEFAULT_MIN_WORDS = 5
STATISTICS = (
    "text_char_count", "text_word_count", "text_sentence_count", "text_avg_word_length", "text_uppercase_ratio",
    "text_digit_ratio", "text_url_count", "text_question_count", "text_exclamation_count", "text_empty_flag",
)
# -----------------------------------------------------------------------------

WS = f"[{WS_CLASS}]"
NONWS = f"[^{WS_CLASS}]"
WORD = f"[{WORD_CLASS}]"

_NON_ASCII = r"[^\x00-\x7f]"
_NEEDS_DECODING = r"[&[^\x00-\x7f]]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Spark has neither an HTML entity decoder nor Unicode normalisation. Callers send NULL for values that
# cannot change, so plain ASCII text never crosses to Python. Values cross pickled, a hundred rows at a time: an Arrow
# batch of long texts and the strings made of it would be held at once, in every worker.
# Zero-width characters are not ASCII either, so they are dropped in the same call.
def _decode_values_singly(v: str | None) -> str | None:
    return v and re.sub(ZERO_WIDTH_PATTERN, "", unicodedata.normalize("NFKC", html.unescape(v)))


def _decode_values(s: pd.Series) -> pd.Series:
    return s.map(_decode_values_singly, na_action="ignore")


def _strip_accents_value(v: str | None) -> str | None:
    return v and "".join(ch for ch in unicodedata.normalize("NFKD", v) if not unicodedata.combining(ch))


_decode = F.udf(_decode_values_singly, T.StringType(), useArrow=False)
_strip_accents = F.udf(_strip_accents_value, T.StringType(), useArrow=False)


def decode_text(c) -> Column:
    """HTML entities decoded, NFKC, zero-width characters dropped."""
    c = _col(c)
    return F.coalesce(_decode(F.when(c.rlike(_NEEDS_DECODING), c)), c)


def strip_accents(c) -> Column:
    c = _col(c)
    return F.coalesce(_strip_accents(F.when(c.rlike(_NON_ASCII), c)), c)


def clean_text(c) -> Column:
    """Entities, NFKC, zero-width, tags, URLs, whitespace; case is kept."""
    s = decode_text(F.coalesce(_col(c), F.lit("")))
    s = F.regexp_replace(s, TAG_PATTERN, " ")
    s = F.regexp_replace(s, URL_PATTERN, " ")
    return F.trim(F.regexp_replace(s, f"{WS}+", " "))


def count_runs(c, run: str, mark: str) -> Column:
    """Number of matches of ``run``; ``mark`` is one character that ``run`` matches."""
    marked = F.regexp_replace(_col(c), run, mark)
    return F.char_length(F.regexp_replace(marked, f"[^{mark}]+", ""))


def count_chars(c, outside: str) -> Column:
    """Number of characters left once runs of the ``outside`` class are removed."""
    return F.char_length(F.regexp_replace(_col(c), outside, ""))


def count_literal(c, ch: str) -> Column:
    c = _col(c)
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(ch), F.lit("")))


def word_count(c) -> Column:
    """Whitespace-separated words, as ``len(s.split())``: the gaps around them but one. Runs of whitespace are
    sought, as Java takes some ten times as long over runs of its complement."""
    spaced = F.regexp_replace(F.concat(F.lit(" "), _col(c), F.lit(" ")), f"{WS}+", " ")
    return F.char_length(F.regexp_replace(spaced, "[^ ]+", "")) - 1


def is_blank(c) -> Column:
    """True when nothing but Unicode whitespace is there; null stays null."""
    return ~_col(c).rlike(NONWS)


def url_domain(c) -> Column:
    """Network location with every ``www.`` removed; ``''`` without ``//``."""
    host = F.regexp_extract(
        _col(c), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1
    )
    return F.replace(host, F.lit("www."), F.lit(""))


def text_statistics(c) -> dict[str, Column]:
    """The ten text statistics by name; null text counts as empty."""
    t = F.coalesce(_col(c), F.lit(""))
    chars = F.char_length(t).cast("double")
    words = count_runs(t, f"{WORD}+", "x").cast("double")
    word_chars = count_chars(t, f"[^{WORD_CLASS}]+").cast("double")
    letters = count_chars(t, "[^A-Za-z]+").cast("double")
    upper = count_chars(t, r"\P{IsUppercase}+").cast("double")
    digits = count_chars(t, r"\P{Nd}+").cast("double")

    def ratio(num, den):
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))

    values = (
        chars,
        words,
        count_runs(t, SENTENCE_END, "!").cast("double"),
        ratio(word_chars, words),
        ratio(upper, letters),
        ratio(digits, chars),
        F.regexp_count(t, F.lit(URL_PATTERN)).cast("double"),
        count_literal(t, "?").cast("double"),
        count_literal(t, "!").cast("double"),
        (words == 0).cast("double"),
    )
    return dict(zip(STATISTICS, values, strict=True))


def tokens(c) -> Column:
    """Lower-case, accent-free tokens of two or more word characters."""
    folded = strip_accents(F.lower(F.coalesce(_col(c), F.lit(""))))
    return F.regexp_extract_all(folded, F.lit(f"{WORD}{{2,}}"), F.lit(0))
