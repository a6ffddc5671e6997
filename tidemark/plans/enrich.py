"""The flagship plan: tweets to a point-in-time dataset with labels."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import market
from ..operators.asof import Lookup, asof_lookups
from ..operators.indicators import NUMERICAL, with_indicators, with_regime
from ..scratch import saved
from .progress import observed

#: The dataset's columns, in order.
OUTPUT = [
    "timestamp", "ticker", "tweet_url", "label_1d_3class", "author", "category", "session", "market_regime", "sector", "market_cap_bucket",
    *NUMERICAL,
    "is_reliable_label", "tweet_hash", "entry_price", "entry_price_flag", "price_next_open", "price_next_open_flag", "return_to_next_open", "hours_to_next_open", "text",
]
#: Columns that a row for training must have.
REQUIRED = ["text", "label_1d_3class", "tweet_hash", *NUMERICAL, "author", "category", "session", "market_regime", "sector", "market_cap_bucket"]


def _midnight(date: str, days: int = 0) -> Column:
    return F.date_add(date, days).cast("timestamp_ntz")


def _priced(df: DataFrame) -> DataFrame:
    """Entry and next open from the looked-up columns ``__i_*`` and ``__n_*``."""
    open_now = F.col("session") != "closed"
    soon, later = F.col("__i_open").isNotNull(), F.col("__n_open").isNotNull()
    return df.withColumns({
        "entry_price": F.when(open_now & soon, F.col("__i_open")).otherwise(F.col("__n_open")),
        "entry_price_flag": F.when(open_now & soon, F.concat("session", F.lit("_next_bar_open"))).when(later, F.concat("session", F.lit("_next_day_open"))).otherwise("no_data_available"),
        "price_next_open": F.col("__n_open"),
        "price_next_open_flag": F.when(later, "next_open_available").otherwise("next_open_unavailable"),
        "__next_date": F.col("__n_bar_date"),
    }).drop("__i_open", "__n_open", "__n_bar_date")


def _entries(daily: DataFrame, intraday: DataFrame) -> list[Lookup]:
    """The first quarter-hour bar after an instant, and the first day that begins after it."""
    return [
        Lookup(intraday, "symbol", "bar_ts", forward=True, prefix="__i_", columns=("open",)),
        Lookup(daily, "symbol", _midnight("bar_date"), forward=True, prefix="__n_", columns=("bar_date", "open")),
    ]


def with_entry_price(tweets: DataFrame, daily: DataFrame, intraday: DataFrame, segment: str | None = None) -> DataFrame:
    """``entry_price, entry_price_flag, price_next_open, price_next_open_flag, __next_date``.

    ``tweets`` have ``ts, et_date, ticker, session``.  While the market is open in any way
    the first quarter-hour bar after the tweet counts, else the next day's open.
    """
    return _priced(asof_lookups(tweets, "ticker", "ts", _entries(daily, intraday), segment=segment))


def with_regime_of_day(df: DataFrame, index: DataFrame) -> DataFrame:
    """``df`` with the regime that the index's last bar before ``et_date`` shows.

    Each bar stands for the days up to the next one: a row for each day of the index's span,
    which is broadcast (some 36,500 a century); later days have the last bar's.
    """
    bars = with_regime(index).withColumn("until", F.lead("bar_date").over(Window.partitionBy("symbol").orderBy("bar_date")))
    bars = saved(bars.select("bar_date", "until", "market_regime"), "regimes")
    last = bars.agg(F.max("bar_date")).first()[0]
    if last is None:
        return df.withColumn("market_regime", F.lit(None).cast("string"))
    days = bars.select(F.explode(F.sequence(F.date_add("bar_date", 1), F.coalesce("until", F.date_add("bar_date", 1)))).alias("__regime_day"), "market_regime")
    return df.join(F.broadcast(days), F.least(F.col("et_date"), F.date_add(F.lit(last), 1)) == F.col("__regime_day"), "left").drop("__regime_day")


def enriched(tweets: DataFrame, daily: DataFrame, intraday: DataFrame, index: DataFrame, metadata: DataFrame, calendar: DataFrame, *, filter_reliable: bool = True, skip_missing: bool = True, segment: str | None = "hour", observation: Observation | None = None) -> DataFrame:
    """The dataset's rows, with the columns of ``OUTPUT`` that exist.

    ``tweets`` have ``ts`` (New York wall clock), ``ticker`` and any of tweet_url, author,
    category, text.  Indicators are those of the last daily bar before the tweet's date, so
    nothing of that day or later is seen.  ``observation`` counts, in the pass that makes the
    rows, all of them, those without an entry price and those with an unreliable label.
    """
    for name in ("tweet_url", "author", "category", "text"):
        if name not in tweets.columns:
            tweets = tweets.withColumn(name, F.lit(None).cast("string"))
    df = tweets.withColumn("et_date", F.col("ts").cast("date"))
    df = market.with_session(df, calendar)
    # One union of tweets and bars: a day's indicators hold from the next midnight on.
    marked = with_indicators(daily).withColumn("last_close", F.col("close"))
    lookups = [*_entries(marked, intraday), Lookup(marked, "symbol", _midnight("bar_date", 1), strict=False, columns=("bar_date", "last_close", *NUMERICAL))]
    df = _priced(asof_lookups(df, "ticker", "ts", lookups, segment=segment)).withColumnRenamed("bar_date", "__bar_day")
    df = with_regime_of_day(df, index)
    df = df.join(market.stock_metadata(metadata), "ticker", "left").withColumns({"sector": F.coalesce("sector", F.lit("Other")), "market_cap_bucket": F.coalesce("market_cap_bucket", F.lit("unknown"))})
    known = F.col("__bar_day").isNotNull()
    df = df.withColumns({
        "entry_price": F.when(known, F.col("entry_price")),
        "entry_price_flag": F.when(known, F.col("entry_price_flag")).otherwise("no_data"),
        "price_next_open": F.when(known, F.col("price_next_open")),
        "market_regime": F.when(known, F.col("market_regime")),
        "price_next_open_flag": F.when(known, F.col("price_next_open_flag")).otherwise("no_data"),
    })
    df = df.withColumn("return_to_next_open", market.return_between(F.col("entry_price"), F.col("price_next_open")))
    hours = (F.unix_micros(F.col("__next_date").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    df = df.withColumns({
        "timestamp": F.col("ts"),
        "hours_to_next_open": F.when(known, hours),
        "label_1d_3class": market.label_3class(F.col("return_to_next_open")),
        "tweet_hash": F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 12),
        "is_reliable_label": market.reliable(F.col("entry_price_flag"), F.col("price_next_open_flag")),
    })
    complete = reduce(and_, [F.col(c).isNotNull() for c in REQUIRED])
    df = df.withColumn("is_reliable_label", F.col("is_reliable_label") & complete)
    df = observed(df, observation, without_price=F.col("entry_price").isNull(), unreliable=~F.col("is_reliable_label"))
    if skip_missing:
        df = df.where(F.col("entry_price").isNotNull())
    if filter_reliable:
        df = df.where(F.col("is_reliable_label") & F.col("label_1d_3class").isNotNull())
    return df.select(*[c for c in ["id", *OUTPUT] if c in df.columns])
