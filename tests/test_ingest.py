"""Stored batches of a tweet stream: what is read, parsed and cleaned, and how often."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.sources import pages, raw
from tidemark.streaming import ingest

TWEET = "id string, ts timestamp, author string, username string, url string, symbols array<string>, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def tweet(i, words):
    return (str(i), None, "a", "u", "", ["ABC"], f"{words} on $ABC and $XYZ, which is long enough to count")


def test_a_batch_is_read_once_and_later_batches_too(spark, tmp_path):
    store, reads = str(tmp_path), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        reads.add(1)
        return x

    commit = ingest._commits(store, 30)
    batches = [[1, 2, 2, 3], [3, 4, 5, 5, 1], [2, 9]]
    for number, ids in enumerate(batches):
        rows = spark.createDataFrame([tweet(i, f"batch {number}") for i in ids], TWEET)
        commit(rows.withColumn("id", counted("id")), number)
        assert reads.value == sum(map(len, batches[: number + 1]))
    want = {("1", 0), ("2", 0), ("3", 0), ("4", 1), ("5", 1), ("9", 2)}
    stored = spark.read.parquet(f"{store}/raw").collect()
    assert {(x.id, x.batch) for x in stored} == want and len(stored) == len(want)
    assert all(x.text.startswith(f"batch {x.batch} ") for x in stored)
    rows = spark.read.parquet(f"{store}/processed").collect()
    assert {(x.id, x.batch, x.ticker) for x in rows} == {(*w, t) for w in want for t in ("ABC", "XYZ")} and len(rows) == 2 * len(want)
    # A batch that is repeated after a crash replaces what it wrote.
    commit(spark.createDataFrame([tweet(i, "again") for i in batches[1]], TWEET), 1)
    again = spark.read.parquet(f"{store}/raw").collect()
    assert {(x.id, x.batch) for x in again} == want and len(again) == len(want)
    # A batch of known tweets alone stores nothing.
    commit(spark.createDataFrame([tweet(4, "known")], TWEET), 3)
    assert {x.batch for x in spark.read.parquet(f"{store}/processed").collect()} == {0, 1, 2}


def test_a_page_and_its_tweets_are_parsed_once(spark, tmp_path):
    (tmp_path / "landed=1").mkdir()
    (tmp_path / "landed=1/_SUCCESS").touch()
    read = pages.read_landed(spark, str(tmp_path))
    assert plan(raw.parse_json(pages.texts_of(read), named=True)).count("from_json") == 2
    assert plan(pages.tweets_of(read)).count("from_json") == 2


def test_a_text_is_cleaned_once_and_rows_per_ticker_stay_where_tweets_are(spark, tmp_path):
    spark.createDataFrame([tweet(1, "one")], TWEET).write.parquet(str(tmp_path / "t"))
    p = plan(text.per_ticker(spark.read.parquet(str(tmp_path / "t"))))
    assert len(re.findall(r"clean_message\(", p)) == 1 and len(re.findall(r"ArrowEvalPython", p)) == 2
    assert "Exchange" not in p and "Sort" not in p


def test_odd_pages_and_tweets(spark, tmp_path):
    body = lambda i, **more: {"id": i, "createdAt": "Wed Jan 10 10:00:00 +0000 2024", "text": f"tweet {i} on $ABC, which is long enough to count", **more}
    lines = [
        {"account": "a", "page": 0, "tweets": None},
        {"account": "a", "page": 1, "tweets": []},
        {"account": "a", "page": 2, "tweets": [None, {"text": "no id"}, body(None), body("1"), json.dumps(body("2")), "no tweet", body("1")]},
        {"account": None, "page": "x", "tweets": [body(""), body(3)]},
        {"account": "b", "data": {"tweets": [body("4", entities="none"), body("5", author="none"), body("6", entities={"symbols": [{"text": "xyz"}, {"text": "ABC"}, None]})]}},
        {"account": "b", "page": 1, "error": "lost"},
        [],
        {},
        "a text",
    ]
    where = tmp_path / "in" / "landed=1"
    where.mkdir(parents=True)
    (where / "part-0").write_text("\n".join(map(json.dumps, lines)) + '\n{"account": "c", "tweets": [\n{"tweets": ["{\\"id\\": \\"7\\", "]}\n')
    (where / "_SUCCESS").touch()
    store = str(tmp_path / "out")
    ingest.sync_landed(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(x.id for x in spark.read.parquet(f"{store}/raw").collect()) == ["", "1", "2", "3", "4", "5", "6"]
    got = sorted((x.id, x.ticker) for x in spark.read.parquet(f"{store}/processed").collect() if x.ticker)
    assert got == [("", "ABC"), ("1", "ABC"), ("2", "ABC"), ("3", "ABC"), ("4", "ABC"), ("5", "ABC"), ("6", "ABC"), ("6", "XYZ")]


@pytest.mark.parametrize("words", [None, "", "   ", "123 $!", "plain", "é", "日本語", "abcdefgh日", "abcd日", "ab日", "ªº", "1日", "ΑΒΓ abc", "🚀", "ascii only, 日 no"])
def test_english_is_told_as_before(spark, words):
    letters = [c for c in words or "" if c.isalpha()]
    latin = [c for c in letters if re.match("[A-Za-zªºÀ-ÖØ-öø-ɏ]", c)]
    want = bool(words) and (not letters or (len(letters) - len(latin)) / len(letters) < 0.2)
    assert spark.createDataFrame([(words,)], "t string").select(text.is_english(F.col("t")).alias("e")).first().e is want
