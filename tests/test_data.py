"""Texts, sources, sinks, streaming, preparation, metrics and the model."""

import json
import tracemalloc
import unicodedata
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import metrics as M
from tidemark.operators import prep as P
from tidemark.operators import ranks, state
from tidemark.sources import crawl, raw, sinks


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("", ""), (None, None), ("ﬁne​  x", "fine x"), ("a—b–c…", "a - b-c..."), ("it’s “so”", "it’s “so”"), ("x‑y", "x‐y"), ("↑5% →", "[up]5%"), ("🚀🚀 up 🔹", "[rocket] [rocket] up"), ("🇺🇸 flag 🦄", "flag"), ("● dot ▪", "dot"), ("  many   blanks ", "many blanks")],
)
def test_cleaning(spark, text, want):
    got = one(spark, X.clean_for_model, text)
    assert got == want
    if want:
        assert one(spark, X.clean_for_model, got) == got == unicodedata.normalize("NFKC", got)


def test_messages(spark):
    assert one(spark, X.clean_message, "Look https://x.com/a/1 here\n\n  and \\(there\\)  \n") == "Look here and (there)"
    assert one(spark, X.tickers, "$AAPL x $BRK.B $b $AAPL") == ["AAPL", "BRK", "AAPL"]
    assert one(spark, X.tweet_url, "see (https://x.com/a/status/1) or https://twitter.com/b") == "https://x.com/a/status/1"


@pytest.mark.parametrize(("text", "want"), [("", False), ("123 !?", True), ("hello", True), ("שלום עולם", False), ("hello wörld é ß", True), ("abcd я", False), ("abcde я", True)])
def test_english(spark, text, want):
    assert one(spark, X.is_english, text) is want


@pytest.mark.parametrize(("text", "want"), [("Q3 eps beats, merger ahead", "Earnings"), ("MERGER talk", "Mergers & Acquisitions"), ("pt: 5", "Guidance & Forecasts"), ("the sec says", "Regulatory & Legal"), ("secret", "Other"), ("", "Other")])
def test_topics(spark, text, want):
    assert one(spark, X.categorized, text) == want


def page(*tweets, nested=True):
    rows = [{"id": i, "text": t, "createdAt": "Wed Jan 15 15:30:00 +0000 2025", "url": "u", "author": {"name": "A", "userName": "a"}, "entities": {"symbols": [{"text": "msft"}]}} for i, t in tweets]
    return json.dumps({"data": {"tweets": rows}} if nested else {"tweets": rows})


def test_pages_and_streaming_dedup(spark, tmp_path):
    from tidemark.streaming.ingest import sync

    land, store = tmp_path / "land", str(tmp_path / "store")
    land.mkdir()
    long = "A long enough text about $AAPL earnings today"
    (land / "1.json").write_text(page(("1", long), ("2", "short")) + "\n" + page(("1", long), nested=False) + "\n")
    sync(spark, str(land), store, str(tmp_path / "cp")).awaitTermination()
    (land / "2.json").write_text(page(("1", long), ("3", long)) + "\n")
    sync(spark, str(land), store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{store}/raw").collect()) == ["1", "2", "3"]
    rows = sorted((r.id, r.ticker, r.category) for r in spark.read.parquet(f"{store}/processed").collect())
    assert rows == [("1", "AAPL", "Earnings"), ("1", "MSFT", "Earnings"), ("3", "AAPL", "Earnings"), ("3", "MSFT", "Earnings")]
    sinks.export_csv(spark.read.parquet(f"{store}/processed"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["timestamp", "author", "ticker", "tweet_url", "category", "text"]


def test_crawl_goes_on_when_an_account_fails(spark):
    def pages(account, cursor):
        if account == "bad":
            raise OSError("down")
        k = int(cursor or 0)
        return [{"id": f"{account}{k}"}], (str(k + 1) if k < 2 else None)

    accounts = spark.createDataFrame([("a",), ("bad",)], "account string")
    known = spark.createDataFrame([("a1",)], "id string")
    got = {(r.account, r.id, r.error) for r in crawl.crawled(accounts, pages, known).collect()}
    assert got == {("a", "a0", None), ("bad", None, "OSError: down")}
    resumed = crawl.crawled(accounts.where("account = 'a'"), pages, cursors=spark.createDataFrame([("a", "2")], "account string, cursor string"))
    assert [r.id for r in resumed.collect()] == ["a2"]


def test_features_that_see_the_future_are_refused(spark):
    df = spark.createDataFrame([(1.0, "x", None)], "entry_price double, sector string, rsi_14 double")
    with pytest.raises(ValueError, match="future"):
        P.feature_columns(df, ["entry_price"], ["sector"])
    assert P.feature_columns(df, ["rsi_14"], ["sector"]).first().rsi_14 == 0


def test_csv_is_read_with_given_types(spark, tmp_path):
    df = spark.createDataFrame([("01", "a,\n\"b\"", 0.5), (None, None, None)], "code string, text string, rsi_14 double")
    sinks.write_dataset(df, str(tmp_path / "d.csv"))
    back = raw.read_csv(spark, str(tmp_path / "d.csv"), raw.DATASET_SCHEMA)
    assert dict(back.dtypes) == dict(df.dtypes) and back.where("code = '01'").first().text == "a,\n\"b\""


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from tidemark.scratch import scratch_root

    conf = SimpleNamespace(get=lambda key, default="": "")
    context = SimpleNamespace(master="spark://host:7077", applicationId="app", getConf=lambda: conf)
    with pytest.raises(ValueError, match="checkpoint.dir"):
        scratch_root(SimpleNamespace(conf=conf, sparkContext=context))


def test_bar_store_and_feather(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import feather

    t = pa.table({"date": pa.array([datetime(2025, 1, 2, 5), datetime(2025, 1, 3, 5)], pa.timestamp("ns", tz="UTC")), "open": [1.0, 2.0], "high": [1.0, 2.0], "low": [1.0, 2.0], "close": [1.0, 2.0], "volume": [10, 20]})
    feather.write_feather(t, tmp_path / "AAPL.feather", compression="uncompressed")
    bars = raw.read_feather_bars(spark, str(tmp_path))
    assert [(r.symbol, str(r.bar_date), r.volume) for r in bars.orderBy("bar_date").collect()] == [("AAPL", "2025-01-02", 10.0), ("AAPL", "2025-01-03", 20.0)]
    store = str(tmp_path / "store")
    sinks.write_bars(bars, store)
    sinks.write_bars(bars.withColumn("symbol", F.lit("MSFT")), store)
    assert raw.read_bars(spark, store, ["AAPL"]).count() == 2 and raw.read_bars(spark, store).count() == 4


def test_ranks_and_p_values(spark):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": r.integers(0, 20, 400).astype(float), "b": r.normal(size=400)})
    df = spark.createDataFrame(pdf)
    got = ranks.spearman(df, "a", "b").first()
    assert got.ic == pytest.approx(pdf.a.rank().corr(pdf.b.rank()), abs=1e-12)
    assert ranks.student_p(0.034, 4275) == pytest.approx(0.0262, abs=1e-3)
    assert ranks.student_p(0.5, 10) == pytest.approx(0.14111, abs=1e-4)
    at = ranks.positions(df.withColumn("id", F.monotonically_increasing_id()), ["b", "id"]).toPandas().sort_values("position")
    assert at.position.tolist() == list(range(400)) and at.b.is_monotonic_increasing


def test_split_sizes_and_guards(spark):
    df = spark.range(42_749).withColumn("ts", F.timestamp_seconds("id"))
    n = {r.split: r["count"] for r in P.split_by_time(df, ["ts", "id"]).groupBy("split").count().collect()}
    assert n == {"train": 34_199, "val": 4_275, "test": 4_275}
    with pytest.raises(ValueError):
        P.feature_columns(df.withColumn("entry_price", F.lit(1.0)), ["entry_price"], [])
    with pytest.raises(ValueError):
        P.split_by_hash(df)
    leak = spark.createDataFrame([("h", "train"), ("h", "test")], "tweet_hash string, split string")
    with pytest.raises(ValueError):
        P.assert_no_leakage(leak)
    known = spark.createDataFrame([("a", 0)], "value string, idx int")
    with pytest.raises(Exception, match="unknown x"):
        P.encoded(spark.createDataFrame([("b",)], "x string"), {"x": known}, "error").collect()


def test_metrics_on_exact_cases(spark):
    rows = [(i, 0.1, 0.1, 0.8, p, p, r) for i, (p, r) in enumerate(zip([2, 2, 0, 0, 1], [0.03, 0.02, -0.02, -0.03, 0.01], strict=True))]
    df = spark.createDataFrame(rows, "id long, p_sell double, p_hold double, p_buy double, pred int, label int, ret double")
    r = M.directional(df).first()
    assert (r.directional_accuracy, r.n_directional) == (1.0, 4)
    s = M.scores(df).first()
    assert (s.accuracy, s.f1_macro) == (1.0, 1.0)
    b = M.baselines(spark.createDataFrame([(0,)] * 6 + [(1,)] * 3 + [(2,)], "label int")).first()
    assert b.naive_accuracy == pytest.approx(0.6) and b.majority_class == 0 and b.random_accuracy == pytest.approx(1 / 3)
    assert M.precision_at(df).first().precision_at_confidence is None
    sweep = {x.threshold: x.status for x in M.confidence_sweep(df).collect()}
    assert set(sweep.values()) == {"insufficient_samples"}


def test_state_tables(spark):
    old = spark.createDataFrame([("a", "1", "c1", 5), ("b", "2", "c2", 1)], "account string, last_tweet_id string, last_cursor string, total_tweets long")
    new = spark.createDataFrame([("a", None, None, 2), ("c", "9", "c9", 3)], "account string, last_tweet_id string, last_cursor string, total_tweets long")
    got = {tuple(r) for r in state.upsert_state(old, new).collect()}
    assert got == {("a", "1", None, 7), ("b", "2", "c2", 1), ("c", "9", "c9", 3)}
    assert state.estimate(6, 30) == {"tweets": 5400, "calls": 270, "seconds": 54.0}


def test_model_end_to_end(spark):
    from tidemark.operators.indicators import NUMERICAL
    from tidemark.plans import model

    r = np.random.default_rng(3)
    n = 300
    label = r.integers(0, 3, n)
    pdf = pd.DataFrame({c: r.normal(size=n) + (label if c == "return_5d" else 0) for c in NUMERICAL})
    pdf = pdf.assign(text=[f"word{k}" for k in label], label_1d_3class=[P.LABELS[k] for k in label], is_reliable_label=True, timestamp=pd.date_range("2024-01-01", periods=n, freq="h"), tweet_hash=[f"{k * 97:08x}0000" for k in range(n)], return_to_next_open=(label - 1) * 0.02)
    for c in model.CATEGORICAL:
        pdf[c] = r.choice(["x", "y"], n)
    rows, artifacts = model.prepared(spark.createDataFrame(pdf), NUMERICAL, model.CATEGORICAL, "timestamp")
    rows = model.vectors(rows, NUMERICAL, model.CATEGORICAL, 64).cache()
    predictions = model.predicted(model.trained(rows, grid=(0.01,)), rows.where("split = 'test'"), "tweet_hash")
    assert M.scores(predictions).first().accuracy > 0.9
    assert set(artifacts) == {*(f"encoding_{c}" for c in model.CATEGORICAL), "scaler", "weights"}


def test_commands_parse():
    from tidemark.cli import parser

    a = parser().parse_args(["prepare", "--tweets", "t", "--output", "o", "--daily-dir", "d", "--intraday-dir", "i", "--metadata", "m"])
    assert a.function.__name__ == "prepare"


def test_a_batch_of_long_texts_is_cleaned_in_pieces(monkeypatch):
    """Python strings of a piece are held, not those of the batch; an emoji makes them four bytes a character."""
    long = "plain words \U0001f680 " * 10_000
    batch = pa.array([None, "", "a  b", *[long] * 60, None, "flﬁp"])
    want = [None, "", "a b", *[("plain words [rocket] " * 10_000).strip()] * 60, None, "flfip"]
    for f in (X.clean_for_model.func, X.clean_message.func):
        tracemalloc.start()
        got = f(batch)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got.to_pylist() == want and peak < 20e6
        monkeypatch.setattr(X, "PIECE", 7)
        assert f(batch.slice(1, 3)).to_pylist() == want[1:4] and f(batch.slice(0, 0)).to_pylist() == []
        monkeypatch.undo()
