"""Queries over bars and tweets: as-of joins, indicators, sessions, labels, the flagship."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import market
from ..operators import bars as B
from ..operators import indicators as I
from ..operators import validate as V
from ..operators.asof import asof_join
from ..scratch import scratch_path
from ..sources import sinks
from ..sources import tables as S
from .enrich import enriched, with_entry_price

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(c, 6).alias(c) for c in names]


@query(f"""WITH {S.TWEETS}, {S.DAILY}
SELECT t.id, t.ticker, d.bar_date, d.close FROM tweets t ASOF LEFT JOIN daily d ON t.ticker = d.symbol AND CAST(t.ts AS DATE) > d.bar_date""")
def asof_backward_strict(spark: SparkSession, sf: str) -> DataFrame:
    t = S.tweets(spark, sf).withColumn("day", F.col("ts").cast("date"))
    return asof_join(t, S.daily_bars(spark, sf), "ticker", "symbol", "day", "bar_date", segment="hour").select("id", "ticker", "bar_date", "close")


@query(f"""WITH {S.TWEETS}, {S.INTRADAY}
SELECT t.id, t.ticker, d.bar_ts, d.open FROM tweets t ASOF LEFT JOIN intraday d ON t.ticker = d.symbol AND t.ts < d.bar_ts""")
def asof_forward_strict(spark: SparkSession, sf: str) -> DataFrame:
    return asof_join(S.tweets(spark, sf), S.intraday_bars(spark, sf), "ticker", "symbol", "ts", "bar_ts", forward=True, segment="hour").select("id", "ticker", "bar_ts", "open")


@query(f"""WITH {S.TWEETS}, {S.DAILY}
SELECT t.id, t.ticker, d.bar_date, d.close FROM tweets t ASOF LEFT JOIN daily d ON t.ticker = d.symbol AND CAST(t.ts AS DATE) >= d.bar_date""")
def asof_backward_inclusive(spark: SparkSession, sf: str) -> DataFrame:
    t = S.tweets(spark, sf).withColumn("day", F.col("ts").cast("date"))
    return asof_join(t, S.daily_bars(spark, sf), "ticker", "symbol", "day", "bar_date", strict=False, segment="hour").select("id", "ticker", "bar_date", "close")


@query(f"""WITH {S.TWEETS}, {S.DAILY}
SELECT t.id, t.ticker, d.bar_date, d.open FROM tweets t ASOF LEFT JOIN daily d ON t.ticker = d.symbol AND CAST(t.ts AS DATE) <= d.bar_date""")
def asof_forward_inclusive(spark: SparkSession, sf: str) -> DataFrame:
    t = S.tweets(spark, sf).withColumn("day", F.col("ts").cast("date"))
    return asof_join(t, S.daily_bars(spark, sf), "ticker", "symbol", "day", "bar_date", forward=True, strict=False, segment="hour").select("id", "ticker", "bar_date", "open")


@query(f"""WITH {S.TWEETS}, {S.DAILY}
SELECT t.id, d.open AS price_next_open, d.bar_date AS next_date,
  CASE WHEN d.open IS NULL THEN 'next_open_unavailable' ELSE 'next_open_available' END AS price_next_open_flag
FROM tweets t ASOF LEFT JOIN daily d ON t.ticker = d.symbol AND CAST(t.ts AS DATE) < d.bar_date""")
def next_open(spark: SparkSession, sf: str) -> DataFrame:
    t = S.tweets(spark, sf).withColumn("day", F.col("ts").cast("date"))
    df = asof_join(t, S.daily_bars(spark, sf), "ticker", "symbol", "day", "bar_date", forward=True, segment="hour")
    return df.select("id", F.col("open").alias("price_next_open"), F.col("bar_date").alias("next_date"), F.when(F.col("open").isNull(), "next_open_unavailable").otherwise("next_open_available").alias("price_next_open_flag"))


def _indicators(*names: str):
    return lambda spark, sf: I.with_indicators(S.daily_bars(spark, sf)).select("symbol", "bar_date", *r6(*names))


NUMBERED = f"""WITH {S.DAILY},
steps AS (SELECT *, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS d,
  CASE WHEN lag(close) OVER w <> 0 THEN (close - lag(close) OVER w) / lag(close) OVER w END AS r FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)),
sma AS (SELECT *, CASE WHEN i >= 19 THEN avg(close) OVER (PARTITION BY symbol ORDER BY bar_date ROWS 19 PRECEDING) END AS sma FROM steps)
"""
QUERIES["ind_returns"] = _indicators("return_5d", "return_20d")
ORACLES["ind_returns"] = NUMBERED + """SELECT symbol, bar_date, round((close - lag(close, 5) OVER w) / lag(close, 5) OVER w, 6) AS return_5d,
  round((close - lag(close, 20) OVER w) / lag(close, 20) OVER w, 6) AS return_20d FROM sma WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)"""
QUERIES["ind_volatility"] = _indicators("volatility_7d")
ORACLES["ind_volatility"] = NUMBERED + """SELECT symbol, bar_date, CASE WHEN i >= 7 THEN round(stddev_samp(r) OVER (PARTITION BY symbol ORDER BY bar_date ROWS 6 PRECEDING), 6) END AS volatility_7d FROM sma"""
QUERIES["ind_relative_volume"] = _indicators("relative_volume")
ORACLES["ind_relative_volume"] = NUMBERED + """SELECT symbol, bar_date, CASE WHEN i >= 20 THEN round(volume / avg(volume) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) END AS relative_volume FROM sma"""
QUERIES["ind_ma"] = _indicators("distance_from_ma_20", "above_ma_20", "slope_ma_20")
ORACLES["ind_ma"] = NUMBERED + """SELECT symbol, bar_date, round((close - sma) / sma, 6) AS distance_from_ma_20, CAST(close > sma AS INTEGER) AS above_ma_20,
  round(sma / lag(sma, 5) OVER (PARTITION BY symbol ORDER BY bar_date) - 1, 6) AS slope_ma_20 FROM sma"""
QUERIES["ind_gap_range"] = _indicators("gap_open", "intraday_range")
ORACLES["ind_gap_range"] = NUMBERED + """SELECT symbol, bar_date, round((open - lag(close) OVER w) / lag(close) OVER w, 6) AS gap_open,
  round((high - low) / lag(close) OVER w, 6) AS intraday_range FROM sma WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)"""
QUERIES["ind_rsi"] = _indicators("rsi_14")
ORACLES["ind_rsi"] = NUMBERED.replace("WITH ", "WITH RECURSIVE ", 1) + """, rsi AS (
  SELECT symbol, bar_date, i, 0::DOUBLE AS up, 0::DOUBLE AS moved FROM steps WHERE i = 0
  UNION ALL
  SELECT s.symbol, s.bar_date, s.i, p.up * 13 / 14 + greatest(s.d, 0), p.moved * 13 / 14 + abs(s.d) FROM rsi p JOIN steps s ON s.symbol = p.symbol AND s.i = p.i + 1)
SELECT symbol, bar_date, CASE WHEN i >= 14 AND moved <> 0 THEN round(100 * up / moved, 6) END AS rsi_14 FROM rsi"""


@query(f"""WITH {S.MARKET},
steps AS (SELECT *, row_number() OVER w - 1 AS i, (close - lag(close) OVER w) / lag(close) OVER w AS r,
  (close - lag(close, 5) OVER w) / lag(close, 5) OVER w AS ret FROM market WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)),
vols AS (SELECT *, CASE WHEN i >= 4 THEN stddev_samp(r) OVER (PARTITION BY symbol ORDER BY bar_date ROWS 3 PRECEDING) * sqrt(252.0) END AS vol FROM steps)
SELECT symbol, bar_date, round(ret, 6) AS regime_return, round(vol, 6) AS regime_volatility,
  CASE WHEN vol > 0.18 THEN 'volatile' WHEN ret > 0.02 THEN 'trending_up' WHEN ret < -0.02 THEN 'trending_down' ELSE 'calm' END AS market_regime FROM vols""")
def regime(spark: SparkSession, sf: str) -> DataFrame:
    return I.with_regime(S.market_bars(spark, sf)).select("symbol", "bar_date", *r6("regime_return", "regime_volatility"), "market_regime")


FIRST, LAST = date(1995, 1, 1), date(2002, 12, 31)


def _closed_list() -> str:
    days = sorted(d for y in range(FIRST.year, LAST.year + 1) for d in market.holidays(y))
    return ", ".join(f"DATE '{d}'" for d in days)


def _half_list() -> str:
    return ", ".join(f"DATE '{d}'" for y in range(FIRST.year, LAST.year + 1) for d in sorted(market.half_days(y)))


SESSIONS = f"""
sessions AS (
  SELECT *, CASE WHEN dayofweek(ts) IN (0, 6) OR CAST(ts AS DATE) IN ({_closed_list()}) THEN 'closed'
    WHEN m >= 570 AND m < closes THEN 'regular' WHEN m >= 240 AND m < 570 THEN 'premarket' WHEN m >= closes AND m < 1200 THEN 'afterhours' ELSE 'closed' END AS session
  FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m, CASE WHEN CAST(ts AS DATE) IN ({_half_list()}) THEN 780 ELSE 960 END AS closes FROM tweets))"""


@query(f"WITH {S.TWEETS}, {SESSIONS} SELECT id, ts, session FROM sessions")
def session(spark: SparkSession, sf: str) -> DataFrame:
    return market.with_session(S.tweets(spark, sf), market.calendar(spark, FIRST, LAST)).select("id", "ts", "session")


ENTRIES = f"""{S.TWEETS}, {S.DAILY}, {S.INTRADAY}, {SESSIONS},
soon AS (SELECT s.*, b.open AS soon_open FROM sessions s ASOF LEFT JOIN intraday b ON s.ticker = b.symbol AND s.ts < b.bar_ts),
later AS (SELECT s.*, d.open AS next_open, d.bar_date AS next_date FROM soon s ASOF LEFT JOIN daily d ON s.ticker = d.symbol AND CAST(s.ts AS DATE) < d.bar_date),
entries AS (SELECT id, ts, ticker, author, text, session, next_date,
  CASE WHEN session <> 'closed' AND soon_open IS NOT NULL THEN soon_open ELSE next_open END AS entry_price,
  CASE WHEN session <> 'closed' AND soon_open IS NOT NULL THEN session || '_next_bar_open' WHEN next_open IS NOT NULL THEN session || '_next_day_open' ELSE 'no_data_available' END AS entry_price_flag,
  next_open AS price_next_open, CASE WHEN next_open IS NOT NULL THEN 'next_open_available' ELSE 'next_open_unavailable' END AS price_next_open_flag FROM later)"""


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    t = market.with_session(S.tweets(spark, sf), market.calendar(spark, FIRST, LAST)).withColumn("et_date", F.col("ts").cast("date"))
    return with_entry_price(t, S.daily_bars(spark, sf), S.intraday_bars(spark, sf), "hour")


@query(f"WITH {ENTRIES} SELECT id, session, entry_price, entry_price_flag, price_next_open, price_next_open_flag FROM entries")
def entry_price(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).select("id", "session", "entry_price", "entry_price_flag", "price_next_open", "price_next_open_flag")


LABELLED = f"""{ENTRIES},
labelled AS (SELECT *, CASE WHEN entry_price <> 0 THEN (price_next_open - entry_price) / entry_price END AS ret,
  NOT regexp_matches(entry_price_flag, 'next_day|unavailable|no_data|closed') AND regexp_matches(entry_price_flag, 'next_bar_open|intraday') AND price_next_open_flag = 'next_open_available' AS prices_ok FROM entries)"""
CLASS = "CASE WHEN ret < -0.005 THEN 'SELL' WHEN ret < 0.005 THEN 'HOLD' WHEN ret IS NOT NULL THEN 'BUY' END"


@query(f"WITH {LABELLED} SELECT {CLASS} AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM labelled GROUP BY 1")
def label_3class(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    e = _entries(spark, sf).withColumn("label", market.label_3class(market.return_between(F.col("entry_price"), F.col("price_next_open"))))
    return e.groupBy("label").agg(F.count("*").alias("n")).withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(f"WITH {LABELLED} SELECT entry_price_flag, price_next_open_flag, prices_ok AS reliable, count(*) AS n FROM labelled GROUP BY ALL")
def reliability(spark: SparkSession, sf: str) -> DataFrame:
    e = _entries(spark, sf).withColumn("reliable", market.reliable(F.col("entry_price_flag"), F.col("price_next_open_flag")))
    return e.groupBy("entry_price_flag", "price_next_open_flag", "reliable").agg(F.count("*").alias("n"))


FLAGSHIP = f"""WITH RECURSIVE {LABELLED}, {S.MARKET}, {S.METADATA},
steps AS (SELECT *, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS d, (close - lag(close) OVER w) / lag(close) OVER w AS r FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)),
rsi AS (
  SELECT symbol, bar_date, i, 0::DOUBLE AS up, 0::DOUBLE AS moved FROM steps WHERE i = 0
  UNION ALL
  SELECT s.symbol, s.bar_date, s.i, p.up * 13 / 14 + greatest(s.d, 0), p.moved * 13 / 14 + abs(s.d) FROM rsi p JOIN steps s ON s.symbol = p.symbol AND s.i = p.i + 1),
sma AS (SELECT *, CASE WHEN i >= 19 THEN avg(close) OVER (PARTITION BY symbol ORDER BY bar_date ROWS 19 PRECEDING) END AS sma FROM steps),
marks AS (SELECT sma.symbol, sma.bar_date,
  CASE WHEN sma.i >= 7 THEN stddev_samp(r) OVER (PARTITION BY sma.symbol ORDER BY sma.bar_date ROWS 6 PRECEDING) END AS volatility_7d,
  CASE WHEN sma.i >= 20 THEN volume / avg(volume) OVER (PARTITION BY sma.symbol ORDER BY sma.bar_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS relative_volume,
  CASE WHEN sma.i >= 14 AND moved <> 0 THEN 100 * up / moved END AS rsi_14, (close - sma) / sma AS distance_from_ma_20,
  (close - lag(close, 5) OVER w) / lag(close, 5) OVER w AS return_5d, (close - lag(close, 20) OVER w) / lag(close, 20) OVER w AS return_20d,
  CAST(close > sma AS INTEGER) AS above_ma_20, sma / lag(sma, 5) OVER w - 1 AS slope_ma_20,
  (open - lag(close) OVER w) / lag(close) OVER w AS gap_open, (high - low) / lag(close) OVER w AS intraday_range
  FROM sma JOIN rsi USING (symbol, bar_date) WINDOW w AS (PARTITION BY sma.symbol ORDER BY sma.bar_date)),
msteps AS (SELECT *, row_number() OVER w - 1 AS i, (close - lag(close) OVER w) / lag(close) OVER w AS r, (close - lag(close, 5) OVER w) / lag(close, 5) OVER w AS ret FROM market WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)),
regimes AS (SELECT bar_date, CASE WHEN vol > 0.18 THEN 'volatile' WHEN ret > 0.02 THEN 'trending_up' WHEN ret < -0.02 THEN 'trending_down' ELSE 'calm' END AS market_regime
  FROM (SELECT *, CASE WHEN i >= 4 THEN stddev_samp(r) OVER (PARTITION BY symbol ORDER BY bar_date ROWS 3 PRECEDING) * sqrt(252.0) END AS vol FROM msteps)),
marked AS (SELECT l.*, m.* EXCLUDE (symbol, bar_date) FROM labelled l ASOF JOIN marks m ON l.ticker = m.symbol AND CAST(l.ts AS DATE) > m.bar_date),
weathered AS (SELECT k.*, g.market_regime FROM marked k ASOF LEFT JOIN regimes g ON CAST(k.ts AS DATE) > g.bar_date)
SELECT id, ts AS timestamp, w.ticker, {CLASS} AS label_1d_3class, author, 'topic' AS category, session, market_regime,
  CASE m.sector WHEN 'Technology' THEN 'Technology' WHEN 'Financial Services' THEN 'Financials' WHEN 'Health Care' THEN 'Healthcare' ELSE 'Other' END AS sector,
  CASE WHEN m.market_cap IS NULL THEN 'unknown' WHEN m.market_cap >= 200e9 THEN 'mega_cap' WHEN m.market_cap >= 10e9 THEN 'large_cap' WHEN m.market_cap >= 2e9 THEN 'mid_cap' ELSE 'small_cap' END AS market_cap_bucket,
  {", ".join(c if c == "above_ma_20" else f"round({c}, 6) AS {c}" for c in I.NUMERICAL)},
  substr(md5(text), 1, 12) AS tweet_hash, entry_price, entry_price_flag, price_next_open, price_next_open_flag,
  round(ret, 6) AS return_to_next_open, round(epoch(next_date - ts) / 3600, 6) AS hours_to_next_open, text
FROM weathered w LEFT JOIN metadata m ON w.ticker = m.ticker
WHERE prices_ok AND {" AND ".join(f"{c} IS NOT NULL" for c in ("ret", "market_regime", *I.NUMERICAL))}"""


@query(FLAGSHIP)
def flagship_dataset(spark: SparkSession, sf: str) -> DataFrame:
    t = S.tweets(spark, sf).withColumn("category", F.lit("topic"))
    out = enriched(t, S.daily_bars(spark, sf), S.intraday_bars(spark, sf), S.market_bars(spark, sf), S.metadata(spark, sf), market.calendar(spark, FIRST, LAST))
    rounded = [c for c in I.NUMERICAL if c != "above_ma_20"] + ["return_to_next_open", "hours_to_next_open"]
    return out.drop("is_reliable_label", "tweet_url").withColumns({c: F.round(c, 6) for c in rounded})


@query(f"""WITH base AS ({FLAGSHIP}) SELECT 'entry_price' AS price, count(*) AS n_rows, count(*) FILTER (id % 13 = 0) AS n_bad FROM base UNION ALL SELECT 'price_next_open', count(*), count(*) FILTER (id % 17 = 0) FROM base""")
def recomputed_prices(spark: SparkSession, sf: str) -> DataFrame:
    """The dataset's prices, some of them planted errors, against those of the bars."""
    out = flagship_dataset(spark, sf)
    out = out.withColumns({"entry_price": F.when(F.col("id") % 13 == 0, F.col("entry_price") + 1).otherwise(F.col("entry_price")), "price_next_open": F.when(F.col("id") % 17 != 0, F.col("price_next_open"))})
    return V.recomputed_prices(out, S.daily_bars(spark, sf), S.intraday_bars(spark, sf))


@query(NUMBERED + """SELECT symbol, bar_date, round((close - sma) / sma, 6) AS distance_from_ma_20 FROM sma""")
def bucketed_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators of a bar table that is bucketed by symbol: no shuffle after its reading."""
    bars = sinks.write_bar_table(S.daily_bars(spark, sf), f"bars_{uuid.uuid4().hex}", scratch_path(spark, "bar-table"), 8)
    return I.with_indicators(bars).select("symbol", "bar_date", *r6("distance_from_ma_20"))


@query(f"WITH {S.DAILY} SELECT symbol, avg(volume) AS avg_volume FROM daily GROUP BY symbol HAVING avg(volume) >= 1.2")
def volume_filter(spark: SparkSession, sf: str) -> DataFrame:
    return B.liquid(S.daily_bars(spark, sf), 1.2)


@query(f"""WITH {S.DAILY}, {S.INTRADAY}, wanted AS (SELECT DISTINCT symbol FROM daily UNION SELECT 'SPY' UNION SELECT '9-NONE'),
d AS (SELECT symbol, min(bar_date) AS daily_start, max(bar_date) AS daily_end, count(*) AS daily_bars FROM daily GROUP BY 1),
i AS (SELECT symbol, min(bar_ts) AS intraday_start, max(bar_ts) AS intraday_end, count(*) AS intraday_bars FROM intraday WHERE symbol <> '2-HIGH' GROUP BY 1)
SELECT symbol, daily_start, daily_end, coalesce(daily_bars, 0) AS daily_bars, intraday_start, intraday_end, coalesce(intraday_bars, 0) AS intraday_bars,
  CASE WHEN daily_bars IS NULL THEN 'missing' WHEN intraday_bars IS NULL THEN 'partial' ELSE 'complete' END AS status
FROM wanted LEFT JOIN d USING (symbol) LEFT JOIN i USING (symbol)""")
def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    daily = S.daily_bars(spark, sf)
    wanted = daily.select("symbol").distinct().union(spark.createDataFrame([("9-NONE",)], "symbol string"))
    return B.coverage(wanted, daily, S.intraday_bars(spark, sf).where("symbol <> '2-HIGH'"))


@query(f"""WITH {S.DAILY}, stored AS (SELECT * FROM daily WHERE bar_date < DATE '1998-01-01'),
fetched AS (SELECT * REPLACE (volume + 1 AS volume) FROM daily WHERE bar_date >= DATE '1997-06-01')
SELECT * FROM stored UNION ALL SELECT f.* FROM fetched f WHERE bar_date > (SELECT max(bar_date) FROM stored s WHERE s.symbol = f.symbol)""")
def merge_append(spark: SparkSession, sf: str) -> DataFrame:
    daily = S.daily_bars(spark, sf)
    return B.appended(daily.where("bar_date < date'1998-01-01'"), daily.where("bar_date >= date'1997-06-01'").withColumn("volume", F.col("volume") + 1))


@query(f"""WITH {S.DAILY}, stored AS (SELECT * FROM daily WHERE bar_date >= DATE '1998-01-01'),
fetched AS (SELECT * REPLACE (volume + 1 AS volume) FROM daily WHERE bar_date < DATE '1998-06-01')
SELECT * FROM stored UNION ALL SELECT f.* FROM fetched f WHERE bar_date < (SELECT min(bar_date) FROM stored s WHERE s.symbol = f.symbol)""")
def merge_backfill(spark: SparkSession, sf: str) -> DataFrame:
    daily = S.daily_bars(spark, sf)
    return B.prepended(daily.where("bar_date >= date'1998-01-01'"), daily.where("bar_date < date'1998-06-01'").withColumn("volume", F.col("volume") + 1))


@query(f"""WITH {S.DAILY}, cut AS (SELECT * FROM daily WHERE NOT (symbol = '1-URGENT' AND bar_date > DATE '2001-01-01') AND NOT (symbol = '2-HIGH' AND bar_date > DATE '2001-07-01')),
wanted AS (SELECT DISTINCT symbol FROM daily UNION SELECT '9-NONE'), lasts AS (SELECT symbol, max(bar_date) AS last_bar FROM cut GROUP BY 1)
SELECT symbol, last_bar, CASE WHEN last_bar IS NULL OR DATE '2001-07-20' - last_bar > 90 THEN 'full' WHEN DATE '2001-07-20' - last_bar <= 0 THEN 'fresh' ELSE 'incremental' END AS state
FROM wanted LEFT JOIN lasts USING (symbol)""")
def freshness_triage(spark: SparkSession, sf: str) -> DataFrame:
    daily = S.daily_bars(spark, sf)
    cut = daily.where("not (symbol = '1-URGENT' and bar_date > date'2001-01-01') and not (symbol = '2-HIGH' and bar_date > date'2001-07-01')")
    wanted = daily.select("symbol").distinct().union(spark.createDataFrame([("9-NONE",)], "symbol string"))
    return B.freshness(wanted, cut, F.lit(date(2001, 7, 20)))


@query(f"""WITH {S.TWEETS} SELECT ticker, CAST(min(CAST(ts AS DATE)) - INTERVAL 1 MONTH AS DATE) AS first_day, least(CAST(max(CAST(ts AS DATE)) + INTERVAL 1 DAY AS DATE), DATE '2001-08-01') AS last_day
FROM tweets WHERE ticker <> '5-LOW' GROUP BY ticker""")
def fetch_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return B.fetch_ranges(S.tweets(spark, sf), F.lit(date(2001, 8, 1)), spark.createDataFrame([("5-LOW",)], "ticker string"))


@query("""WITH m AS (SELECT s_name AS ticker, CASE s_suppkey % 5 WHEN 0 THEN 'Technology' WHEN 1 THEN 'Financial Services' WHEN 2 THEN 'Health Care' WHEN 3 THEN 'Shipping' END AS sector,
  CASE WHEN s_suppkey % 7 <> 0 THEN abs(s_acctbal) * s_acctbal * 5000 END AS market_cap FROM supplier)
SELECT ticker, CASE sector WHEN 'Technology' THEN 'Technology' WHEN 'Financial Services' THEN 'Financials' WHEN 'Health Care' THEN 'Healthcare' ELSE 'Other' END AS sector,
  CASE WHEN market_cap IS NULL THEN 'unknown' WHEN market_cap >= 200e9 THEN 'mega_cap' WHEN market_cap >= 10e9 THEN 'large_cap' WHEN market_cap >= 2e9 THEN 'mid_cap' ELSE 'small_cap' END AS market_cap_bucket FROM m""")
def stock_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Sectors and sizes of all suppliers as if they were listed, some of them unknown."""
    k = F.col("s_suppkey") % 5
    name = F.when(k == 0, "Technology").when(k == 1, "Financial Services").when(k == 2, "Health Care").when(k == 3, "Shipping")
    cap = F.when(F.col("s_suppkey") % 7 != 0, F.abs("s_acctbal") * F.col("s_acctbal") * 5000)
    return market.stock_metadata(S.table(spark, sf, "supplier").select(F.col("s_name").alias("ticker"), name.alias("sector"), cap.alias("market_cap")))


@query("""SELECT event_type AS symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS bar_ts, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS volume
FROM events GROUP BY 1, 2""")
def event_bars(spark: SparkSession, sf: str) -> DataFrame:
    e = S.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.window("ts", "15 minutes").getField("start").alias("bar_ts"), F.col("event_id").alias("o_orderkey"), F.col("value").alias("p"))
    return S.bars_of(e, ["symbol", "bar_ts"])


@query(f"WITH {S.TWEETS}, {SESSIONS} SELECT session, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM sessions GROUP BY session")
def session_distribution(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    n = session(spark, sf).groupBy("session").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(f"""WITH {S.INTRADAY}, wanted AS (SELECT DISTINCT symbol FROM intraday UNION SELECT '9-NONE'), lasts AS (SELECT symbol, max(bar_ts) AS last_bar FROM intraday GROUP BY 1)
SELECT symbol, last_bar, CASE WHEN last_bar IS NULL OR DATE '2001-08-01' - CAST(last_bar AS DATE) > 30 THEN 'full'
  WHEN DATE '2001-08-01' < CAST(last_bar AS DATE) OR (DATE '2001-08-01' = CAST(last_bar AS DATE) AND hour(last_bar) >= 16) THEN 'fresh' ELSE 'incremental' END AS state
FROM wanted LEFT JOIN lasts USING (symbol)""")
def intraday_freshness(spark: SparkSession, sf: str) -> DataFrame:
    bars = S.intraday_bars(spark, sf)
    wanted = bars.select("symbol").distinct().union(spark.createDataFrame([("9-NONE",)], "symbol string"))
    return B.intraday_freshness(wanted, bars, F.lit(date(2001, 8, 1)))


@query(f"""WITH t AS ({FLAGSHIP})
SELECT name AS "check", (SELECT count(*) FROM t) AS n_rows, 0 AS n_bad FROM (VALUES ('label_matches_return'), ('return_matches_prices'), ('hash_matches_text'), ('session_is_known'), ('prices_are_positive'), ('reliable_has_prices'), ('next_open_is_later')) AS v(name)""")
def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.validate import violations

    t = S.tweets(spark, sf).withColumn("category", F.lit("topic"))
    return violations(enriched(t, S.daily_bars(spark, sf), S.intraday_bars(spark, sf), S.market_bars(spark, sf), S.metadata(spark, sf), market.calendar(spark, FIRST, LAST)))
