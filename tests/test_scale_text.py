"""Cleaning whose memory must not grow with the rows of a task or the length of its texts."""

from credence.functions.text import clean_text, decode_text, strip_accents


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_cross_to_python_a_few_at_a_time(spark):
    """F6, F22, F23 and others: decoding and folding hold no Arrow batch of whole texts."""
    df = spark.createDataFrame([("a &amp; b",), ("\u00e9t\u00e9 \u200b\ufb01n",), ("plain",), ("",), (None,)], "t string")
    out = df.select(decode_text("t").alias("d"), strip_accents("t").alias("s"), clean_text("t").alias("c"))
    assert "ArrowEvalPython" not in _plan(out) and "BatchEvalPython" in _plan(out)
    assert [tuple(r) for r in out.collect()] == [
        ("a & b", "a &amp; b", "a & b"), ("\u00e9t\u00e9 fin", "ete \u200bfin", "\u00e9t\u00e9 fin"), ("plain",) * 3, ("",) * 3, (None, None, "")
    ]
