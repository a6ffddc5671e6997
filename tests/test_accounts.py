"""Sync states that a stream keeps per account, against the batch form."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.sources.versioned import Store
from tidemark.streaming import accounts
from tidemark.streaming.accounts import keep_account_states

ROW = "account string, id string, cursor string, ts timestamp"


def at(hours):
    return datetime(2024, 1, 1) + timedelta(hours=hours)


def rows(store):
    return {x.account: (x.last_tweet_id, x.last_cursor, x.total_tweets, x.quiet) for x in store.read().collect()}


def test_a_stream_in_batches_equals_the_batch_form_late_rows_and_restarts_included(spark, tmp_path):
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"), ["account"], 4)

    def land(*tweets):
        spark.createDataFrame(list(tweets), ROW).coalesce(1).write.mode("append").parquet(source)

    def run(quiet=0):
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source)
        keep_account_states(stream, store, str(tmp_path / "cp"), "2 days", quiet).awaitTermination()

    land(("a", "1", "c1", at(1)), ("a", "2", "c2", at(2)), ("b", "9", None, at(1)), (None, "3", "x", at(1)), ("c", "4", "x", None))
    land(("a", None, "c3", at(3)), ("b", "8", "late", at(0)))
    run()
    assert rows(store) == {"a": ("2", "c3", 3, False), "b": ("9", None, 2, False)}
    version = store.manifest().version
    run()
    assert store.manifest().version == version  # nothing landed, nothing changes
    # A late one counts; after a restart the state goes on.
    land(("a", "5", "old", at(-20)), ("d", "7", "c", at(2)))
    land(("b", "10", "c9", at(200)))
    run()
    assert rows(store) == {"a": ("2", "c3", 4, False), "b": ("10", "c9", 3, False), "d": ("7", "c", 1, False)}
    # Later than the watermark allows: left out.
    land(("a", "6", "too late", at(0)), ("b", "11", "c10", at(201)))
    run()
    assert rows(store)["a"] == ("2", "c3", 4, False) and rows(store)["b"] == ("11", "c10", 4, False)

    # The same as folding the batches' sums in order.
    schema = "account string, last_tweet_id string, last_cursor string, total_tweets long"
    plain = spark.createDataFrame([], schema)
    for change in ([("a", "2", "c2", 2), ("b", "9", None, 1)], [("a", None, "c3", 1)], [("d", "7", "c", 1)], [("b", "10", "c9", 1)], [("b", "11", "c10", 1)]):
        plain = state.upsert_state(plain, spark.createDataFrame(change, schema))
    want = {x.account: (x.last_tweet_id, x.last_cursor) for x in plain.collect()}
    assert {k: v[:2] for k, v in rows(store).items()} == want


def test_timers_tell_which_accounts_are_quiet(spark, tmp_path):
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"), ["account"], 4)
    for n, tweets in enumerate(([("a", "1", "c", at(0)), ("b", "2", "c", at(0))], [("b", "3", "c", at(100))], [("b", "4", "c", at(101))], [("a", "5", "c", at(102))])):
        spark.createDataFrame(tweets, ROW).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROW).parquet(source)
        keep_account_states(stream, store, str(tmp_path / "cp"), "1 hour", 24).awaitTermination()
        quiet = {x.account: x.quiet for x in store.read().select("account", "quiet").collect()}
        if n == 2:
            assert quiet == {"a": True, "b": False}
    assert quiet == {"a": False, "b": False}
    assert store.read().agg(F.sum("total_tweets")).first()[0] == 5


def test_a_state_is_folded_in_the_jvm_and_ties_do_not_hang_on_order(spark, tmp_path):
    """One grouping, no Python for each account."""
    tweets = [("a", "1", "x", at(1)), ("a", "1", "y", at(1)), ("a", None, "z", at(2)), ("b", None, None, at(1)), ("a", "0", "late", at(0))]
    for order in (tweets, tweets[::-1]):
        one = accounts.folded(accounts.tweet_states(spark.createDataFrame(order, ROW)))
        assert {tuple(r)[:5] for r in one.collect()} == {("a", "1", "z", 4, at(2)), ("b", None, None, 1, at(1))}
    assert "Python" not in one._jdf.queryExecution().toString()
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"), ["account"], 4)
    for _ in range(2):
        rows = spark.range(5000).selectExpr("cast(id as string) account", "cast(id as string) id", "'c' cursor", "timestamp'2024-01-01' ts")
        rows.coalesce(1).write.mode("append").parquet(source)
    keep_account_states(spark.readStream.schema(ROW).parquet(source), store, str(tmp_path / "cp")).awaitTermination()
    assert store.read().where("total_tweets = 2 and last_tweet_id = account").count() == 5000
