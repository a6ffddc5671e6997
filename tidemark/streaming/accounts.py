"""State kept per account while tweets stream in: last tweet, cursor, totals, and silence.

The state of an account is one row of a versioned store, so it doesn't grow with its tweets.
A batch is folded into the stored rows by grouping, under the batch's number, so a batch that
is repeated after a crash changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.versioned import Store

#: Besides what is shown: where the id and the cursor came from, for late tweets.
STATE = ["account", "last_tweet_id", "last_cursor", "total_tweets", "last_ts", "quiet", "id_ts", "cursor_key"]


def tweet_states(tweets: DataFrame) -> DataFrame:
    """The state after each tweet alone; tweets without an account or a time are left out."""
    rows = tweets.select("account", F.col("id").cast("string").alias("last_tweet_id"), F.col("cursor").cast("string").alias("last_cursor"), F.lit(1).cast("long").alias("total_tweets"), F.col("ts").cast("timestamp").alias("last_ts"), F.lit(False).alias("quiet"))
    rows = rows.where("account is not null and last_ts is not null")
    return rows.withColumns({"id_ts": F.when(F.col("last_tweet_id").isNotNull(), F.col("last_ts")), "cursor_key": F.coalesce("last_tweet_id", F.lit(""))}).select(STATE)


def folded(states: DataFrame) -> DataFrame:
    """One state of all of an account's states.

    The tweet with the latest (ts, id) gives the cursor, and its id; where that is null the
    latest one with an id does.  Late tweets count and change nothing else.
    """
    newest = F.max(F.struct("last_ts", "cursor_key", "last_cursor")).alias("c")
    named = F.max(F.when(F.col("id_ts").isNotNull(), F.struct("id_ts", "last_tweet_id"))).alias("i")
    one = states.groupBy("account").agg(newest, named, F.sum("total_tweets").alias("total_tweets"))
    return one.select("account", "i.last_tweet_id", "c.last_cursor", "total_tweets", "c.last_ts", F.lit(False).alias("quiet"), "i.id_ts", "c.cursor_key")


def keep_account_states(tweets: DataFrame, store: Store, checkpoint: str, lateness: str = "7 days", quiet_hours: int = 0, writer: str = "accounts") -> StreamingQuery:
    """Keep ``(account, last_tweet_id, last_cursor, total_tweets, last_ts, quiet)`` of a stream
    of ``(account, id, cursor, ts)`` in ``store`` (keys ``account``), each batch once.

    The watermark lies ``lateness`` behind the latest tweet of earlier batches; a batch's tweets
    that are older are left out.  With ``quiet_hours`` an account is ``quiet`` once the watermark
    after a batch is so far behind its last tweet.
    """
    micros = lambda c: F.unix_micros(c - F.expr(f"interval {lateness}"))

    def commit(batch: DataFrame, number: int) -> None:
        stored, changes = store.read(), tweet_states(batch)
        before = None if stored is None else stored.agg(micros(F.max("last_ts"))).first()[0]
        if before is not None:
            changes = changes.where(F.unix_micros("last_ts") > before)
        quiet = F.lit(False)
        if quiet_hours:
            after = max((x for x in (before, changes.agg(micros(F.max("last_ts"))).first()[0]) if x is not None), default=0)
            quiet = F.unix_micros("last_ts") <= after - quiet_hours * 3_600_000_000
            if stored is not None:  # accounts that fall silent without a tweet of this batch
                changes = changes.unionByName(stored.where(quiet & ~F.col("quiet")).withColumn("total_tweets", F.lit(0).cast("long")))
        store.merge(changes, lambda held, new: folded(held.unionByName(new)).withColumn("quiet", quiet), batch=(writer, number))

    return tweets.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
