"""Tables that a crawler keeps: raw and processed tweets, sync state and fetch journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_new(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` and the rows whose key it lacks, each key once."""
    return stored.unionByName(rows.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def upsert_state(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Sync states ``(account, last_tweet_id, last_cursor, total_tweets)`` after changes.

    A new tweet id wins if there is one, the cursor is the change's in any case, and
    counts add up.  Accounts without a change stay.
    """
    c = changes.select("account", *[F.col(x).alias(f"__{x}") for x in ("last_tweet_id", "last_cursor", "total_tweets")], F.lit(True).alias("__there"))
    df = stored.join(c, "account", "full_outer")
    return df.select("account", F.coalesce("__last_tweet_id", "last_tweet_id").alias("last_tweet_id"), F.when(F.col("__there"), F.col("__last_cursor")).otherwise(F.col("last_cursor")).alias("last_cursor"), (F.coalesce("total_tweets", F.lit(0)) + F.coalesce("__total_tweets", F.lit(0))).alias("total_tweets"))


def upsert_backfill(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Backfill states ``(account, cursor, target_date, complete)`` after changes.

    A change sets cursor and completeness in any case, the target date only if it has one.
    """
    c = changes.select("account", *[F.col(x).alias(f"__{x}") for x in ("cursor", "target_date", "complete")], F.lit(True).alias("__there"))
    df = stored.join(c, "account", "full_outer")
    new = lambda x: F.when(F.col("__there"), F.col(f"__{x}")).otherwise(F.col(x)).alias(x)
    return df.select("account", new("cursor"), F.coalesce("__target_date", "target_date").alias("target_date"), new("complete"))


def latest_journal(entries: DataFrame) -> DataFrame:
    """The last entry of each (account, fetch_date) by ``fetched_at``."""
    w = Window.partitionBy("account", "fetch_date").orderBy(F.desc("fetched_at"), F.desc("tweets_count"))
    return entries.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def journal_gaps(journal: DataFrame, days: int = 2) -> DataFrame:
    """``(account, prev_date, fetch_date, gap_days)`` where fetches are further apart."""
    w = Window.partitionBy("account").orderBy("fetch_date")
    df = journal.select("account", "fetch_date").distinct().withColumn("prev_date", F.lag("fetch_date").over(w))
    df = df.withColumn("gap_days", F.datediff("fetch_date", "prev_date"))
    return df.where(F.col("gap_days") > days).select("account", "prev_date", "fetch_date", "gap_days")


def journal_summary(journal: DataFrame) -> DataFrame:
    return journal.groupBy("account").agg(F.count("*").alias("n_days"), F.sum("tweets_count").alias("n_tweets"), F.min("fetch_date").alias("first_day"), F.max("fetch_date").alias("last_day"))


def days_to_fetch(accounts: DataFrame, journal: DataFrame, first, last) -> DataFrame:
    """(account, fetch_date) from ``first`` to the day before ``last`` without an entry."""
    grid = accounts.select("account", F.explode(F.sequence(first, F.date_sub(last, 1))).alias("fetch_date"))
    return grid.join(journal.select("account", "fetch_date"), ["account", "fetch_date"], "left_anti")


def status_report(accounts: DataFrame, state: DataFrame, raw: DataFrame, journal: DataFrame) -> DataFrame:
    counts = raw.groupBy("account").agg(F.count("*").alias("n_raw"))
    days = journal.groupBy("account").agg(F.count_distinct("fetch_date").alias("n_days"))
    df = accounts.join(state, "account", "left").join(counts, "account", "left").join(days, "account", "left")
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_tweets", "n_raw", "n_days")})


def estimate(accounts: int, days: int, delay: float = 0.2, per_day: int = 30, per_call: int = 20) -> dict[str, float]:
    """Tweets, calls and seconds that a fetch will take."""
    tweets = accounts * days * per_day
    calls = max(1, tweets // per_call)
    return {"tweets": tweets, "calls": calls, "seconds": calls * delay}


def estimated(rows: DataFrame, account: str, day: Column, delay: float = 0.2, per_day: int = 30, per_call: int = 20) -> DataFrame:
    """``estimate`` for the accounts and days of a table, in one row."""
    n = rows.agg(F.count_distinct(account).alias("accounts"), F.count_distinct(day).alias("days"))
    n = n.withColumn("tweets", F.col("accounts") * F.col("days") * per_day)
    n = n.withColumn("calls", F.greatest(F.lit(1).cast("long"), F.floor(F.col("tweets") / per_call)))
    return n.withColumn("seconds", F.col("calls") * delay)


def table_stats(processed: DataFrame) -> DataFrame:
    return processed.agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_tweets"), F.count_distinct("ticker").alias("n_tickers"), F.count_distinct("author").alias("n_authors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


#: Registers of a sketch: 2**14, some 16 KB; its standard error is below 1 %.
SKETCH = 14
SKETCHED = {"id": "n_tweets", "ticker": "n_tickers", "author": "n_authors"}


def daily_sketches(processed: DataFrame, precision: int = SKETCH) -> DataFrame:
    """Per day of ``ts``: rows, bounds, and sketches of distinct ids, tickers and authors.

    Rows of this table are merged by ``sketched_stats``, so that statistics of any range of
    days read a row a day.  Rows without a time are those of the null day.
    """
    return processed.groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        *[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(precision)).alias(f"{c}_sketch") for c in SKETCHED],
    )


def merged_sketches(stored: DataFrame, more: DataFrame) -> DataFrame:
    """Days of both tables: counts add up, bounds widen, sketches unite (for ``Store.merge``)."""
    return stored.unionByName(more).groupBy("day").agg(
        F.sum("n_rows").alias("n_rows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        *[F.hll_union_agg(f"{c}_sketch").alias(f"{c}_sketch") for c in SKETCHED],
    )


def sketched_stats(sketches: DataFrame, since=None, until=None) -> DataFrame:
    """``table_stats`` of the days from ``since`` to ``until`` (both included, None: open).

    Numbers of rows and bounds are exact, distinct ones are estimates.
    """
    for given, test in ((since, F.col("day") >= F.lit(since)), (until, F.col("day") <= F.lit(until))):
        if given is not None:
            sketches = sketches.where(test)
    return sketches.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")), F.lit(0)).alias(name) for c, name in SKETCHED.items()],
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )


def selected(processed: DataFrame, since=None, until=None, author=None, ticker=None) -> DataFrame:
    """Rows within both bounds (inclusive), of an author and of a ticker where given."""
    tests = ((since, F.col("ts") >= F.lit(since)), (until, F.col("ts") <= F.lit(until)), (author, F.col("author") == F.lit(author)), (ticker, F.col("ticker") == F.lit(ticker)))
    for given, test in tests:
        if given is not None:
            processed = processed.where(test)
    return processed


def newest_journal(journal: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` last journal rows, newest first (a report)."""
    return journal.orderBy(F.desc("fetch_date"), "account").limit(n)


def sampled(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` random rows, the same for the same seed: those with the least hash of their key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def sync_totals(results: DataFrame) -> DataFrame:
    """Totals over ``(account, n_raw, n_processed, api_calls, error)``: accounts that failed
    count as such, and with nothing else."""
    fine = F.col("error").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(fine, F.col(c))), F.lit(0)).cast("long").alias(c)
    return results.agg(F.count("*").alias("n_accounts"), F.count_if(~fine).alias("n_failed"), total("n_raw"), total("n_processed"), total("api_calls"))


def concentration(rows: DataFrame, by: str, label: Column | None = None, top: int = 10) -> DataFrame:
    """The ``top`` values of ``by``: rows, rank, cumulative share, and the labels' shares."""
    labels = {k: F.avg((label == k).cast("double")) for k in ("SELL", "HOLD", "BUY")} if label is not None else {}
    n = rows.groupBy(by).agg(F.count("*").alias("n"), *[v.alias(f"share_{k.lower()}") for k, v in labels.items()])
    best = n.orderBy(F.desc("n"), by).limit(top).join(F.broadcast(n.agg(F.sum("n").alias("__all"))))  # a report of a few rows
    w = Window.orderBy(F.desc("n"), by)
    share = F.sum(F.col("n") / F.col("__all")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return best.withColumns({"rank": F.row_number().over(w), "cumulative_share": share}).drop("__all")
