"""The driver's tables as tweets, bars, predictions and the like.

``orders`` plays the market: its priority is the symbol, its price the quote, and each
order is a tweet at a minute of its day that follows from its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minute(factor: int):
    """The order's time: its day and the minute ``key * factor mod 1440`` of it."""
    return (F.col("o_orderdate") + F.make_interval(mins=((F.col("o_orderkey") * factor) % 1440).cast("int"))).cast("timestamp_ntz")


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, ts, ticker, author, text)``; ts is New York wall-clock time."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        _minute(37).alias("ts"),
        F.col("o_orderpriority").alias("ticker"),
        F.concat(F.lit("author"), (F.col("o_custkey") % 50).cast("string")).alias("author"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" on $"), F.col("o_orderpriority")).alias("text"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(symbol, bar_date, open, high, low, close, volume)`` of all orders of a day."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("bar_date"), "o_orderkey", F.col("o_totalprice").alias("p"))
    return bars_of(o, ["symbol", "bar_date"])


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the market as a whole, under the symbol SPY."""
    o = table(spark, sf_dir, "orders").select(F.lit("SPY").alias("symbol"), F.col("o_orderdate").cast("date").alias("bar_date"), "o_orderkey", F.col("o_totalprice").alias("p"))
    return bars_of(o, ["symbol", "bar_date"])


def intraday_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(symbol, bar_ts, open, ...)`` in quarters of an hour."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), (F.col("o_orderdate") + F.make_interval(mins=(F.floor((F.col("o_orderkey") * 53 % 1440) / 15) * 15).cast("int"))).cast("timestamp_ntz").alias("bar_ts"), "o_orderkey", F.col("o_totalprice").alias("p"))
    return bars_of(o, ["symbol", "bar_ts"])


def bars_of(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Open, high, low, close and volume of ``(keys, o_orderkey, p)`` ticks."""
    return ticks.groupBy(*keys).agg(
        F.min_by("p", "o_orderkey").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o_orderkey").alias("close"), F.count("*").alias("volume")
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ticker, sector, market_cap)`` raw stock metadata, one row for most symbols."""
    rows = [("1-URGENT", "Technology", 2.5e11), ("2-HIGH", "Financial Services", 5.0e10), ("3-MEDIUM", "Health Care", 3.0e9), ("4-NOT SPECIFIED", "Shipping", 1.0e8)]
    return spark.createDataFrame(rows, "ticker string, sector string, market_cap double")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, p_sell, p_hold, p_buy, pred, label, ret)`` from the embeddings' numbers."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    z = [F.exp(8 * F.get(e, F.lit(k))) for k in range(3)]
    total = z[0] + z[1] + z[2]
    p = [F.round(x / total, 9) for x in z]
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[x.alias(n) for x, n in zip(p, ("p_sell", "p_hold", "p_buy"), strict=True)], (F.col("label") % 3).cast("int").alias("label"), F.when(F.col("vec_id") % 17 != 0, F.round(F.get(e, F.lit(3)) * 0.05, 9)).alias("ret"))
    best = F.greatest("p_sell", "p_hold", "p_buy")
    return df.withColumn("pred", F.when(F.col("p_sell") == best, 0).when(F.col("p_hold") == best, 1).otherwise(2))


TWEETS = """
tweets AS (
  SELECT o_orderkey AS id, o_orderdate + to_minutes(CAST(o_orderkey * 37 % 1440 AS INTEGER)) AS ts, o_orderpriority AS ticker,
         'author' || CAST(o_custkey % 50 AS VARCHAR) AS author,
         'Order ' || CAST(o_orderkey AS VARCHAR) || ' on $' || o_orderpriority AS text
  FROM orders)"""
DAILY = """
daily AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS bar_date, arg_min(o_totalprice, o_orderkey) AS open,
         max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
  FROM orders GROUP BY ALL)"""
MARKET = """
market AS (
  SELECT 'SPY' AS symbol, CAST(o_orderdate AS DATE) AS bar_date, arg_min(o_totalprice, o_orderkey) AS open,
         max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
  FROM orders GROUP BY ALL)"""
INTRADAY = """
intraday AS (
  SELECT o_orderpriority AS symbol, o_orderdate + to_minutes(CAST(o_orderkey * 53 % 1440 // 15 * 15 AS INTEGER)) AS bar_ts,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
  FROM orders GROUP BY ALL)"""
METADATA = """
metadata(ticker, sector, market_cap) AS (VALUES ('1-URGENT', 'Technology', 2.5e11), ('2-HIGH', 'Financial Services', 5.0e10),
  ('3-MEDIUM', 'Health Care', 3.0e9), ('4-NOT SPECIFIED', 'Shipping', 1.0e8))"""
PREDICTIONS = """
raw_scores AS (
  SELECT vec_id AS id, CAST(label % 3 AS INTEGER) AS label, exp(8 * embedding[1]::DOUBLE) AS a, exp(8 * embedding[2]::DOUBLE) AS b,
         exp(8 * embedding[3]::DOUBLE) AS c, CASE WHEN vec_id % 17 <> 0 THEN round(embedding[4]::DOUBLE * 0.05, 9) END AS ret
  FROM embeddings),
scores AS (
  SELECT id, label, ret, round(a / (a + b + c), 9) AS p_sell, round(b / (a + b + c), 9) AS p_hold, round(c / (a + b + c), 9) AS p_buy FROM raw_scores),
predictions AS (
  SELECT *, CASE WHEN p_sell = greatest(p_sell, p_hold, p_buy) THEN 0 WHEN p_hold = greatest(p_sell, p_hold, p_buy) THEN 1 ELSE 2 END AS pred,
         greatest(p_sell, p_hold, p_buy) AS conf FROM scores)"""
