"""Bar stores: merging, freshness, coverage, volume and date ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _latest(rows: DataFrame, time: str) -> DataFrame:
    newest = Window.partitionBy("symbol", time).orderBy(F.desc("__new"))
    return rows.withColumn("__k", F.row_number().over(newest)).where("__k = 1").drop("__k", "__new")


def _merged(stored: DataFrame, fetched: DataFrame, time: str, newer: bool) -> DataFrame:
    edge = stored.groupBy("symbol").agg((F.max if newer else F.min)(time).alias("__edge"))
    beyond = F.col(time) > F.col("__edge") if newer else F.col(time) < F.col("__edge")
    fresh = fetched.join(edge, "symbol", "left").where(F.col("__edge").isNull() | beyond).drop("__edge")
    return _latest(stored.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1))), time)


def appended(stored: DataFrame, fetched: DataFrame, time: str = "bar_date") -> DataFrame:
    """Stored bars and those fetched ones that are later than a symbol's last."""
    return _merged(stored, fetched, time, True)


def prepended(stored: DataFrame, fetched: DataFrame, time: str = "bar_date") -> DataFrame:
    """Stored bars and those fetched ones that are earlier than a symbol's first."""
    return _merged(stored, fetched, time, False)


def freshness(symbols: DataFrame, bars: DataFrame, target: Column, time: str = "bar_date", most_days: int = 90) -> DataFrame:
    """``(symbol, last_bar, state)``: fresh, incremental, or full for none or an old one."""
    last = bars.groupBy("symbol").agg(F.max(time).cast("date").alias("last_bar"))
    gap = F.datediff(target, F.col("last_bar"))
    state = F.when(F.col("last_bar").isNull() | (gap > most_days), "full").when(gap <= 0, "fresh").otherwise("incremental")
    return symbols.join(last, "symbol", "left").select("symbol", "last_bar", state.alias("state"))


def intraday_freshness(symbols: DataFrame, bars: DataFrame, target: Column, most_days: int = 30) -> DataFrame:
    """As ``freshness``; the target's day itself is fresh only from 16:00 on."""
    last = bars.groupBy("symbol").agg(F.max("bar_ts").alias("last_bar"))
    gap = F.datediff(target, F.col("last_bar").cast("date"))
    full = F.col("last_bar").isNull() | (gap > most_days)
    state = F.when(full, "full").when((gap < 0) | ((gap == 0) & (F.hour("last_bar") >= 16)), "fresh").otherwise("incremental")
    return symbols.join(last, "symbol", "left").select("symbol", "last_bar", state.alias("state"))


def coverage(symbols: DataFrame, daily: DataFrame, intraday: DataFrame) -> DataFrame:
    """Per wanted symbol (and SPY) what bars there are, and complete, partial or missing."""
    wanted = symbols.select("symbol").union(symbols.sparkSession.createDataFrame([("SPY",)], "symbol string")).distinct()
    d = daily.groupBy("symbol").agg(F.min("bar_date").alias("daily_start"), F.max("bar_date").alias("daily_end"), F.count("*").alias("daily_bars"))
    i = intraday.groupBy("symbol").agg(F.min("bar_ts").alias("intraday_start"), F.max("bar_ts").alias("intraday_end"), F.count("*").alias("intraday_bars"))
    df = wanted.join(d, "symbol", "left").join(i, "symbol", "left")
    status = F.when(F.col("daily_bars").isNull(), "missing").when(F.col("intraday_bars").isNull(), "partial").otherwise("complete")
    return df.withColumns({"daily_bars": F.coalesce("daily_bars", F.lit(0)), "intraday_bars": F.coalesce("intraday_bars", F.lit(0)), "status": status})


def liquid(bars: DataFrame, least: float = 1e6) -> DataFrame:
    """``(symbol, avg_volume)`` of symbols whose mean volume is ``least`` or more."""
    return bars.groupBy("symbol").agg(F.avg("volume").alias("avg_volume")).where(F.col("avg_volume") >= least)


def fetch_ranges(tweets: DataFrame, today: Column, excluded: DataFrame | None = None) -> DataFrame:
    """``(ticker, first_day, last_day)`` to fetch: a month before a ticker's first tweet to
    the day after its last, today at most."""
    if excluded is not None:
        tweets = tweets.join(excluded, "ticker", "left_anti")
    span = tweets.groupBy("ticker").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return span.select("ticker", F.add_months(F.col("a").cast("date"), -1).alias("first_day"), F.least(F.date_add(F.col("b").cast("date"), 1), today).alias("last_day"))
