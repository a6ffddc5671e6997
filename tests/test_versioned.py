"""The versioned store, and the bar sync that merges in place."""

from datetime import date, datetime, timedelta

import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import bars, state
from tidemark.sources import versioned
from tidemark.sources.versioned import Conflict, Store, upserted


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v long")


def test_merges_write_only_the_buckets_they_touch(spark, tmp_path):
    store = Store(spark, str(tmp_path), ["k"], 8)
    assert store.read() is None
    every = [(f"k{n}", n) for n in range(100)] + [(None, -1)]
    assert store.merge(table(spark, *every), upserted(["k"])) == 1
    first = store.manifest()
    old = store.read()
    assert store.merge(table(spark, ("k3", 333), ("k3", 300), ("new", 5)), upserted(["k"], "v")) == 2
    second = store.manifest()
    moved = {b for b in second.folders if second.folders[b] != first.folders.get(b)}
    assert 1 <= len(moved) <= 2 and set(first.folders) <= set(second.folders)
    assert rows(store.read()) == sorted([x for x in every if x[0] != "k3"] + [("k3", 333), ("new", 5)], key=repr)
    # A reader of the first version sees it still, and so does who asks for it.
    assert rows(old) == rows(store.read(1)) == sorted(every, key=repr)
    assert store.merge(table(spark).limit(0), upserted(["k"])) == 2
    assert store.merge(table(spark, (None, 7)), upserted(["k"])) == 3
    assert [v for k, v in rows(store.read()) if k is None] == [7]
    store.vacuum(keep=1)
    assert store.versions() == [3] and len(rows(store.read())) == 102


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    schema = "account string, last_tweet_id string, last_cursor string, total_tweets long"
    store = Store(spark, str(tmp_path), ["account"], 4)
    batch = lambda n, *x: store.merge(spark.createDataFrame(list(x), schema), state.upsert_state, batch=("sync", n))
    assert batch(0, ("a", "1", "c", 5), ("b", None, None, 1)) == 1
    assert batch(1, ("a", None, "d", 2)) == 2
    assert batch(1, ("a", None, "d", 2)) == 2 and batch(0, ("a", "1", "c", 5)) == 2
    assert rows(store.read()) == [("a", "1", "d", 7), ("b", None, None, 1)]


def test_of_two_merges_at_once_the_later_fails_and_leaves_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path), ["k"], 4)
    store.merge(table(spark, ("a", 1)), upserted(["k"]))

    def slow(stored, changes):
        assert store.merge(table(spark, ("b", 2)), upserted(["k"])) == 2  # another one, meanwhile
        return upserted(["k"])(stored, changes)

    with pytest.raises(Conflict):
        store.merge(table(spark, ("c", 3)), slow)
    assert rows(store.read()) == [("a", 1), ("b", 2)]
    assert {n.split("-")[0] for n in store.files.names("data")} == {"v=1", "v=2"} and not [n for n in store.files.names("manifests") if n.endswith("tmp")]


def test_a_merge_that_fails_leaves_the_old_version(spark, tmp_path):
    store = Store(spark, str(tmp_path), ["k"], 4)
    store.merge(table(spark, ("a", 1)), upserted(["k"]))
    bad = lambda old, new: old.unionByName(new.withColumn("v", F.raise_error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):
        store.merge(table(spark, ("a", 2)), bad)
    assert store.versions() == [1] and rows(store.read()) == [("a", 1)]


def test_merged_bars_equal_the_plain_merge(spark, tmp_path):
    schema = "symbol string, bar_date date, close double"
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    make = lambda r: spark.createDataFrame([(f"S{s}", day(n), float(s * n)) for s in range(20) for n in r if s % 5 or n % 2], schema)
    store = Store(spark, str(tmp_path), ["symbol"], 16)
    whole = make(range(10, 20)).limit(0)
    for fetched, merge in ((make(range(10, 20)), bars.appended), (make(range(15, 30)), bars.appended), (make(range(0, 12)), bars.prepended)):
        store.merge(fetched, merge, order=["symbol", "bar_date"])
        whole = merge(whole, fetched)
    assert rows(store.read()) == rows(whole)


def test_ohlcv_sync_in_place(spark, tmp_path, capfd):
    landing, store = tmp_path / "landing", tmp_path / "store"
    landing.mkdir()

    def land(symbol, days, close, folder=landing, hour=0):
        at = [datetime(2024, 1, d, hour) for d in days]
        n = len(days)
        feather.write_feather(pa.table({"date": pa.array(at, pa.timestamp("us")), **{c: [close] * n for c in ("open", "high", "low", "close", "volume")}}), f"{folder}/{symbol}_daily.feather")

    def run(*more):
        a = cli.parser().parse_args(["ohlcv-sync", "--landing", str(landing), "--store", str(store), *more])
        a.function(spark, a)
        return {(x.symbol, x.bar_date.day): x.close for x in Store(spark, str(store)).read().collect()}

    land("A", [3, 4], 1.0)
    land("B", [3], 1.0)
    assert run() == {("A", 3): 1.0, ("A", 4): 1.0, ("B", 3): 1.0}
    land("A", [2, 4, 5], 2.0)
    assert run() == run() == {("A", 3): 1.0, ("A", 4): 1.0, ("A", 5): 2.0, ("B", 3): 1.0}
    assert run("--backfill")[("A", 2)] == 2.0
    quarters, inner = tmp_path / "quarters", tmp_path / "inner"
    quarters.mkdir()
    land("A", [3], 1.0, quarters, 10)
    a = cli.parser().parse_args(["ohlcv-sync", "--landing", str(quarters), "--store", str(inner), "--intraday", "--buckets", "2"])
    a.function(spark, a)
    assert [x.bar_ts for x in Store(spark, str(inner)).read().select(F.col("bar_ts").cast("string").alias("bar_ts")).collect()] == ["2024-01-03 15:00:00"]
    a = cli.parser().parse_args(["ohlcv-status", "--daily-dir", str(store), "--intraday-dir", str(inner), "--details"])
    a.function(spark, a)
    assert "A" in capfd.readouterr().out
    assert versioned.BUCKETS == 64
