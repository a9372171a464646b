"""Text expressions against the Python standard library."""

import html
import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from credence.functions.text import clean_text, is_blank, text_statistics, tokens, url_domain, word_count

HAND = [
    "<p>Vaccines   cause X!  See https://example.com &amp; more</p>",
    "zero\u200bwidth \ufeff x", "Ｆｕｌｌ ﬁne", "&lt;b&gt;x", "", None, "a\u00a0b\u2003c\x1cd",
    "1234 5678", "ÉCOLE ÉTÉ", "a.b?!c", "www.a.b c www. d", "hhttp://x w", "&ampx &copy &notin;", "_ x_y 1٢",
    "tab\tnew\nline\r\n", "https://", "İstanbul ΣΣ", "A1b2? Yes! No... http://a/b?c",
]


def python_clean(s):
    if s is None:
        return ""
    s = unicodedata.normalize("NFKC", html.unescape(s))
    for pattern, by in (
        ("[\u200b\u200c\u200d\ufeff]", ""), ("<[^>]+>", " "), (r"https?://\S+|www\.\S+", " "), (r"\s+", " ")
    ):
        s = re.sub(pattern, by, s)
    return s.strip()


def python_statistics(s):
    s = s or ""
    words = re.findall(r"\w+", s)
    letters = len(re.findall("[A-Za-z]", s))
    return {
        "text_char_count": len(s),
        "text_word_count": len(words),
        "text_sentence_count": len(re.findall("[.!?]+", s)),
        "text_avg_word_length": sum(map(len, words)) / len(words) if words else 0,
        "text_uppercase_ratio": sum(c.isupper() for c in s) / letters if letters else 0,
        "text_digit_ratio": len(re.findall(r"\d", s)) / len(s) if s else 0,
        "text_url_count": len(re.findall(r"https?://\S+|www\.\S+", s)),
        "text_question_count": s.count("?"),
        "text_exclamation_count": s.count("!"),
        "text_empty_flag": float(not words),
    }


@pytest.fixture(scope="module")
def samples(spark, sf):
    given = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    given += [r[0] for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()]
    return HAND + given


@pytest.fixture(scope="module")
def frame(spark, samples):
    return spark.createDataFrame(list(enumerate(samples)), "i int, s string").repartition(5)


def _collect(df):
    return [r[1] for r in sorted(df.collect())]


def test_clean(frame, samples):
    assert _collect(frame.select("i", clean_text("s"))) == [python_clean(s) for s in samples]


def test_word_count(frame, samples):
    got = _collect(frame.select("i", word_count(F.coalesce("s", F.lit("")))))
    assert got == [len((s or "").split()) for s in samples]


def test_statistics(frame, samples):
    stats = text_statistics("s")
    rows = sorted(frame.select("i", *[c.alias(n) for n, c in stats.items()]).collect())
    for row, s in zip(rows, samples):
        expected = python_statistics(s)
        assert row.asDict() == pytest.approx({"i": row["i"], **expected}), s


def test_tokens(frame, samples):
    def python_tokens(s):
        s = unicodedata.normalize("NFKD", (s or "").lower())
        return re.findall(r"\b\w\w+\b", "".join(c for c in s if not unicodedata.combining(c)))

    assert _collect(frame.select("i", tokens("s"))) == [python_tokens(s) for s in samples]


def test_blank_and_every_space(spark):
    spaces = [chr(c) for c in range(0x3101) if chr(c).isspace()]
    others = [chr(c) for c in range(1, 0x3101) if not chr(c).isspace() and not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in spaces + others], "c string")
    got = {r["c"] for r in df.where(is_blank("c")).collect()}
    assert got == set(spaces)


def test_url_domain(spark):
    cases = {
        "www.a.com/x": "", "https://u@www.a.com:80/p": "u@a.com:80", "//www.a.com": "a.com",
        "http://a b/": "a b", "http://www.www.a.com": "a.com", "https://x.org?q=1": "x.org", "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r["u"]: r["d"] for r in df.select("u", url_domain("u").alias("d")).collect()} == cases
    assert spark.range(1).select(url_domain(F.lit(None).cast("string"))).first()[0] is None


def test_udf_sees_only_rows_that_need_it():
    from credence.functions import text

    assert text._decode_values(pd.Series([None, "&amp;"])).tolist() == [None, "&"]
