import os

import pytest
from pyspark.sql import functions as F

from credence.operators.preprocess import (
    first_occurrences, handle_missing, pipeline_counts, preprocess_dataset, remove_duplicates,
)
from credence.operators.profile import (
    clip_tail, hist_engagement, histogram, inspect_dataframe, profile_duplicates, profile_labels,
)
from credence.operators import prefix, ranks
from credence.operators.prefix import quantiles
from credence.plans import corpora
from credence.session import release, staged
from credence.sources.standard import standardize


def _table(spark, rows):
    return standardize(spark.createDataFrame(rows, "_ord long, id string, title string, text string, label int"))


def test_handle_missing(spark):
    df = _table(spark, [
        (0, "a", "t", "one two three four", 1),
        (1, "b", "t", "one two three four five", 0),
        (2, "c", "a title of five words", " ​", 1),
        (3, "d", "t", "one two three four five", None),
        (4, "e", None, None, 0),
        (5, "f", "t", "one two three four <b>five</b>", 1),
    ])
    rows = {r["id"]: r for r in handle_missing(df).collect()}
    assert set(rows) == {"b", "c", "f"}
    assert rows["c"]["text"] == "a title of five words"
    assert rows["f"]["text"] == "one two three four five"
    assert handle_missing(df, min_words=4).count() == 4


def test_filter_does_not_clean_twice(spark, sf):
    plan = handle_missing(corpora.documents(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_decode_values") == 2  # once for the title, once for the text


def test_duplicates(spark):
    df = _table(spark, [
        (0, "x", "", "Same Text", 1),
        (1, "x", "", "other", 0),       # repeated id, dropped before texts are compared
        (2, "y", "", "same text", 0),   # opposite label, first one wins
        (3, "z", "", "Other", 1),       # its twin went with the id
        (4, "w", "", "last", 1),
    ])
    kept = remove_duplicates(df.repartition(3))
    assert sorted(r["id"] for r in kept.collect()) == ["w", "x", "z"]
    assert remove_duplicates(kept).count() == 3
    assert {r["_ord"] for r in kept.collect()} == {0, 3, 4}


@pytest.mark.parametrize("order", ["long", "struct<part:int,file:string,row:bigint>"])
def test_wide_rows_are_not_moved_by_the_semi_join(spark, order):
    value = F.struct(F.lit(1).alias("part"), F.lit("f").alias("file"), F.col("id").alias("row")) if "struct" in order else F.col("id")
    rows = spark.range(4000).select(
        value.cast(order).alias("_ord"), F.concat(F.lit("d"), "id").alias("id"),
        F.concat(F.lit("t"), (F.col("id") / 2).cast("long")).alias("text"),
    )
    before = set(staged())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = remove_duplicates(rows)
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert done.count() == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = plan.split("\n")
    join = next(k for k, line in enumerate(lines) if "ShuffledHashJoin" in line)
    wide = next(k for k, line in enumerate(lines) if k > join and "FileScan" in line)
    assert "Bucketed: true" in lines[wide] and "text" in lines[wide].split("ReadSchema")[1]
    assert not any("Exchange" in line or "Sort" in line for line in lines[join + 1 : wide])
    (path,) = set(staged()) - before
    (table,) = [t for t in spark.catalog.listTables() if path.endswith(t.name)]
    release(spark, [path])
    assert path not in staged() and not spark.catalog.tableExists(table.name) and not os.path.exists(path.removeprefix("file:"))


def test_hot_copy_group(spark):
    rows = spark.range(30000).select(
        F.col("id").alias("_ord"), F.concat(F.lit("d"), "id").alias("id"),
        F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("t"), "id")).alias("text"),
    )
    assert first_occurrences(rows).count() == 20001
    plan = first_occurrences(rows)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_pipeline_is_partition_independent(spark, sf):
    df = corpora.documents(spark, sf)
    out = preprocess_dataset(df)
    again = preprocess_dataset(df.repartition(3, "text"))
    pick = ["id", "label", "split", "text_len", "word_count"]
    assert sorted(out.select(pick).collect()) == sorted(again.select(pick).collect())
    counts = pipeline_counts(df).first()
    assert counts["rows_deduplicated"] == out.count()
    assert counts["rows_raw"] >= counts["rows_filtered"] >= counts["rows_deduplicated"]
    assert profile_duplicates(out).first()["duplicate_texts"] == 0


def test_profile(spark):
    df = standardize(spark.createDataFrame(
        [(None, "a", 1), (None, "a", None), ("x", " ", 0), ("x", "", 0), ("y", None, 0)],
        "id string, text string, label int"))
    row = profile_duplicates(df).first()
    assert (row["duplicate_ids"], row["duplicate_texts"], row["blank_texts"]) == (2, 1, 3)
    labels = {r["label"]: (r["n"], r["pct"]) for r in profile_labels(df).collect()}
    assert labels == {None: (1, 20.0), 1: (1, 20.0), 0: (3, 60.0)}
    sections = {r["section"] for r in inspect_dataframe(df, "t").collect()}
    assert sections >= {"dtypes", "missing", "missing_pct", "label_counts", "label_pct", "context_available", "rows"}


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_quantiles(spark, ranges):
    import numpy as np

    rng = np.random.default_rng(3)
    values = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), rng.integers(0, 60, 500) / 4)]
    df = spark.createDataFrame(values + [(0, None)], "g int, v double").repartition(4)
    got = {r["g"]: r for r in quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.99}, ["g"], ranges=ranges).collect()}
    for g in range(3):
        mine = [v for k, v in values if k == g]
        assert [got[g][c] for c in "abc"] == pytest.approx(list(np.quantile(mine, [0.25, 0.5, 0.99])))


def test_pipeline_counts_read_the_corpus_once(spark):
    rows = [(k, f"i{k % 8}", "t", f"one two three four five {k % 7}" if k % 3 else "short", k % 2) for k in range(40)]
    source, passed = _table(spark, rows).repartition(4), spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    counts = pipeline_counts(source.mapInArrow(watched, source.schema)).collect()
    kept = handle_missing(source)
    want = (40, kept.count(), first_occurrences(kept).count())
    assert [tuple(r) for r in counts] == [want] and 0 < want[2] < want[1] < 40
    assert passed.value == 40
    assert pipeline_counts(source.where("id = 'nobody'")).first() == (0, 0, 0)
    assert pipeline_counts(_table(spark, [])).first() == (0, 0, 0)


@pytest.mark.parametrize("fetched", [0, 3, 100])
@pytest.mark.parametrize("kind", ["different", "few", "one", "powers"])
def test_quantiles_by_counting(spark, fetched, kind, monkeypatch):
    """Doubles that all differ, few values, one value, and values of all magnitudes; null groups are groups."""
    import numpy as np

    monkeypatch.setattr(ranks, "FETCHED", fetched)
    monkeypatch.setattr(ranks, "MARKS", 8)
    rng = np.random.default_rng(5)
    n = 700
    values = {
        "different": rng.normal(size=n) * 1e3, "few": rng.integers(0, 4, n) * 1.5, "one": np.full(n, -2.5),
        "powers": 2.0 ** rng.integers(-900, 900, n) * rng.choice([-1, 1], n),
    }[kind]
    rows = [(None if g == 3 else int(g), float(v)) for g, v in zip(rng.integers(0, 4, n), values)]
    df = spark.createDataFrame(rows + [(0, None), (9, 4.0), (8, None)], "g int, v double").repartition(5)
    probs = {"lo": 0.0, "a": 0.25, "b": 0.5, "c": 0.99, "hi": 1.0}
    got = {r["g"]: r for r in quantiles(df, "v", probs, ["g"]).collect()}
    assert set(got) == {0, 1, 2, None, 9}
    for g, row in got.items():
        mine = [v for k, v in rows if k == g] or [4.0]
        assert [row[c] for c in probs] == pytest.approx(list(np.quantile(mine, list(probs.values()))), rel=1e-12)
    whole = quantiles(df, "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(np.quantile([*values, 4.0], 0.5), rel=1e-12)
    assert quantiles(df.where("v > 1e300 and v < 0"), "v", {"m": 0.5}, ["g"]).count() == 0
    monkeypatch.setattr(prefix, "MOST_INTERVALS", 1)  # too many groups: the other way, the same result
    other = {r["g"]: r for r in quantiles(df, "v", probs, ["g"]).collect()}
    assert other.keys() == got.keys() and all(other[g][c] == pytest.approx(got[g][c], rel=1e-12) for g in got for c in probs)


def test_histograms(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 4, None] if v is not None], "x double")
    bins = {r["bin"]: r["n"] for r in histogram(df, "x", 4).collect()}
    assert bins == {0: 1, 1: 1, 2: 1, 3: 3}
    assert clip_tail(df, "x", 0.5).count() == 3
    one = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    # a range of one value reaches a half to either side
    assert [(r["bin"], r["n"]) for r in histogram(one, "x", 4).collect()] == [(2, 2)]
    no_counts = standardize(spark.createDataFrame([("a",)], "id string"))
    assert hist_engagement(no_counts).count() == 0
