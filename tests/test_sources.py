import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from credence.schema import STANDARD_COLUMNS
from credence.sources import load_dataset, load_processed, load_standardized_data, save_processed
from credence.sources.delimited import headers, read_delimited, read_records
from credence.sources.standard import standardize
from credence.sources.tables import load_config, save_config
from credence.operators.preprocess import add_text_stats


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def _by_id(df):
    return {r["id"]: r for r in df.collect()}


@pytest.fixture
def reviews_root(tmp_path):
    root = tmp_path / "corpus" / "dataset"
    reviews = [
        {"news_id": "a", "rating": 2.99, "news_source": "", "source": "x"},
        {"news_id": "b", "rating": 3, "news_source": "n", "source": "x"},
        {"news_id": "c", "rating": None},
        {"news_id": "d", "rating": "2"},
        {"news_id": "gone", "rating": 1},
    ]
    _write(root / "reviews" / "HealthStory.json", json.dumps(reviews))
    for i in "abcd":
        _write(root / "content" / "HealthStory" / f"{i}.json", json.dumps({"title": f"t{i}", "text": f"body {i}"}))
    eng = root / "engagements" / "HealthStory"
    _write(eng / "a.json", json.dumps({"tweets": [], "replies": [1, 2], "retweets": [{"id": 1}]}))
    _write(eng / "b.json", json.dumps({"tweets": [{"id": 5, "t": "x"}], "retweets": []}))
    (root / "user_network").mkdir()
    return root.parent


def test_reviews(spark, reviews_root):
    rows = _by_id(load_dataset("FakeHealth", reviews_root))
    assert set(rows) == {f"fakehealth_HealthStory_{i}" for i in "abcd"}
    a, b, c, d = (rows[f"fakehealth_HealthStory_{i}"] for i in "abcd")
    assert [r["label"] for r in (a, b, c, d)] == [1, 0, None, 1]
    assert (a["n_tweets"], a["n_replies"], a["n_retweets"]) == (0, 2, 1)
    assert (b["n_tweets"], b["n_replies"], b["n_retweets"]) == (1, 0, 0)
    assert c["n_tweets"] is None and not c["has_engagement"] and a["has_engagement"]
    assert a["source"] == "x" and b["source"] == "n" and c["source"] is None
    assert not c["has_source"] and all(r["has_network"] for r in rows.values())
    ordered = sorted(rows.values(), key=lambda r: r["_ord"])
    assert [r["id"][-1] for r in ordered] == list("abcd")


def test_reviews_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_dataset("fakehealth", tmp_path)


def test_snapshots(spark, tmp_path):
    root = tmp_path / "snap shots"
    _write(
        root / "05-01-2020" / "NewsFakeCOVID-19.csv",
        'id,news_url,title,content,abstract,tweet_id\n'
        '7,https://www.a.com/x,"T, ""q""","line 1\nline 2",abs,1\t2\t3\n'
        '8,www.a.com/x,NA,,fallback,\n',
    )
    _write(
        root / "05-01-2020" / "NewsRealCOVID-19.csv",
        "title,news_url,content,tweet_id\nnoid,http://b.org,c0,5\nnoid2,,c1,\n",
    )
    _write(root / "05-01-2020" / "ClaimRealCOVID-19.csv", "id,title\n1,claim\n")
    rows = _by_id(load_dataset("coaid", root))
    f7, f8 = rows["coaid_05-01-2020_News_Fake_7"], rows["coaid_05-01-2020_News_Fake_8"]
    assert f7["title"] == 'T, "q"' and f7["text"] == "line 1\nline 2" and f7["n_tweets"] == 3
    assert f7["source"] == "a.com" and f7["label"] == 1 and f7["label_raw"] == "NewsFake"
    assert f8["title"] is None and f8["text"] == "fallback" and f8["n_tweets"] is None
    assert f8["source"] == "" and not f8["has_source"]
    r0, r1 = rows["coaid_05-01-2020_News_Real_0"], rows["coaid_05-01-2020_News_Real_1"]
    assert r0["label"] == 0 and r0["source"] == "b.org" and r1["source"] is None
    assert len(rows) == 4
    ordered = [r["id"].split("_", 3)[-1] for r in sorted(rows.values(), key=lambda r: r["_ord"])]
    assert ordered == ["Fake_7", "Fake_8", "Real_0", "Real_1"]
    assert load_dataset("coaid", root, include_claims=True).where("subset = 'claim'").count() == 1


def test_claims(spark, tmp_path):
    head = "claim_id\tclaim\tmain_text\tlabel\n"
    _write(tmp_path / "train.tsv", head + "1\tc1\tm1\ttrue\n2\tc2\tm2\tmixture\n")
    _write(tmp_path / "test.tsv", head + "3\tc3\t\tfalse\n4\tc4\tm4\t\n")
    rows = _by_id(load_dataset("pubhealth", tmp_path))
    assert {k: r["label"] for k, r in rows.items()} == {"pubhealth_1": 0, "pubhealth_3": 1}
    assert rows["pubhealth_3"]["text"] is None and rows["pubhealth_1"]["title"] == "c1"
    kept = _by_id(load_dataset("pubhealth", tmp_path, keep_labels=("true", "mixture")))
    assert kept["pubhealth_2"]["label"] is None
    with pytest.raises(FileNotFoundError):
        load_dataset("pubhealth", tmp_path / "no")


def test_standardize(spark):
    df = spark.createDataFrame(
        [("1", "  ", "12", "x"), ("2", "s", "nan", "3")], "id string, source string, n_tweets string, n_replies string"
    )
    out = standardize(df)
    assert out.columns == STANDARD_COLUMNS
    one, two = out.orderBy("id").collect()
    assert not one["has_source"] and two["has_source"]
    assert one["n_tweets"] == 12 and one["n_replies"] is None and two["n_tweets"] is None
    assert one["has_engagement"] and two["n_replies"] == 3 and one["has_network"] is False


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip(spark, tmp_path, fmt):
    df = add_text_stats(
        standardize(
            spark.createDataFrame(
                [("1", "", 'He said "hi",\nthen left', 1, 0.0), ("2", None, " lead", None, None)],
                "id string, title string, text string, label int, n_tweets double",
            )
        )
    )
    path = save_processed(df, "x", tmp_path, fmt)
    back = load_processed("x", tmp_path, fmt)
    assert path.endswith(f"x_processed.{fmt}")
    assert back.dtypes == df.dtypes
    assert sorted(back.collect()) == sorted(df.collect())


QUOTED = [
    ["id", "text\nof many lines", 'a "name"'],
    ["0", "plain", ""], ["1", 'says "hi", leaves', "x"], ["2", "two\nlines", "three\r\nmore\n"], ["3", ',"', '","'], ["4", "\n\n", ',\n"'],
    ["5", '"', '""'], ["6", "", '"\n'], ["7", "long " * 60 + "\n" + "tail " * 60, "\n,"], ["8", 'a,"b",\n"c"', "\x01\x02"], ["9", "é\n日本", "z"],
]


@pytest.mark.parametrize("block", [5, 40, 200, 100_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_at_block_edges(spark, tmp_path, block, end):
    """Records are those of the csv module, wherever the file is cut into blocks."""
    r = random.Random(block)
    rows = QUOTED[1:] + [[str(k), "".join(r.choices('ab",\n', k=r.randint(0, 12))), r.choice(QUOTED)[1]] for k in range(10, 60)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for name, quoting in (("minimal", csv.QUOTE_MINIMAL), ("all", csv.QUOTE_ALL)):
            with open(tmp_path / f"{name} 1+1.csv", "w", encoding="utf-8-sig" if name == "all" else "utf-8", newline="") as f:
                csv.writer(f, quoting=quoting, lineterminator=end).writerows([QUOTED[0], *rows])
        (tmp_path / "empty.csv").write_text("")
        (tmp_path / "header only.csv").write_text("id,other\n")
        records = read_records(spark, str(tmp_path))
        if block <= 200:
            assert records.sparkSession.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 5
        back = [x for x in read_delimited(spark, [f"{tmp_path}/{n}.csv" for n in ("minimal 1+1", "all 1+1", "header only")], numbered="no").collect()]
        assert sorted({x for _, x in headers(records)}) == sorted([tuple(QUOTED[0]), ("id", "other")])
        for name in ("minimal", "all"):
            own = sorted((x for x in back if x["_file"].endswith(f"{name} 1+1.csv")), key=lambda x: x["_row"])
            assert [[x[c] or "" for c in QUOTED[0]] for x in own] == rows
            assert [x["no"] for x in own] == [str(k) for k in range(len(rows))]
        assert len(back) == 2 * len(rows)
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(k) if k not in kept else spark.conf.set(k, kept[k])


def test_stray_quotes_and_blank_lines(spark, tmp_path):
    """A quote inside a cell is a sign; empty lines are no records; an open quote runs to the end of the file."""
    text = 'a,b\n\n1,5" pipe\n2,x "y"\n\n"3"x,4\n5,"open\n6,7\n'
    (tmp_path / "t.csv").write_text(text)
    rows = sorted(read_delimited(spark, [f"{tmp_path}/t.csv"]).collect(), key=lambda x: x["_row"])
    assert [(x["a"], x["b"]) for x in rows[:2]] == [("1", '5" pipe'), ("2", 'x "y"')]
    assert rows[2]["b"] == "4" and rows[3]["a"] == "5" and rows[3]["b"].startswith("open\n6,7") and len(rows) == 4


def test_csv_table_in_folders(spark, tmp_path):
    df = standardize(spark.createDataFrame([("1", "a\nb", 1), ("2", 'c"d', 0)], "id string, text string, label int")).withColumn("split", F.lit("train"))
    path = save_processed(add_text_stats(df), "y", tmp_path, "csv", partition_by=("split",))
    back = load_standardized_data(path)
    assert sorted((r["id"], r["text"], r["label"], r["split"], r["text_len"]) for r in back.collect()) == [("1", "a\nb", 1, "train", 3), ("2", 'c"d', 0, "train", 3)]


def test_configuration(spark, tmp_path):
    config = {"seed": 42, "name": 'a "b"\nc', "rates": [0.5, None], "nested": {"é": True}}
    save_config(spark, config, f"{tmp_path}/config")
    assert load_config(spark, f"{tmp_path}/config") == config
    save_config(spark, {}, f"{tmp_path}/config")
    assert load_config(spark, f"{tmp_path}/config") == {}


def test_unknown_suffix_and_path(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_standardized_data(tmp_path / "none.csv")
    (tmp_path / "t.json").write_text("{}")
    with pytest.raises(ValueError):
        load_standardized_data(tmp_path / "t.json")
