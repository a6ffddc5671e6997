"""Trading calendar, market sessions, labels and stock metadata as expressions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Minutes since midnight in New York, and the half-day's close.
OPEN, CLOSE, PREMARKET, AFTERHOURS, HALF_DAY = 570, 960, 240, 1200, 780
#: Days on which the exchange stayed closed for one reason or another.
ONE_OFF = ("1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")
#: Sectors by the name that metadata sources use.
SECTORS = {
    "Technology": "Technology",
    "Information Technology": "Technology",
    "Communication Services": "Communications",
    "Consumer Cyclical": "Consumer",
    "Consumer Defensive": "Consumer",
    "Consumer Discretionary": "Consumer",
    "Consumer Staples": "Consumer",
    "Financial Services": "Financials",
    "Financials": "Financials",
    "Healthcare": "Healthcare",
    "Health Care": "Healthcare",
    "Industrials": "Industrials",
    "Energy": "Energy",
    "Basic Materials": "Materials",
    "Materials": "Materials",
    "Utilities": "Utilities",
    "Real Estate": "Real Estate",
}


def easter(year: int) -> date:
    """Western Easter Sunday (Butcher's rule)."""
    a, b, c = year % 19, year // 100, year % 100
    d, e, g = b // 4, b % 4, (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = c // 4, c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = (a + 11 * h + 22 * m) // 451
    month, day = divmod(h + m - 7 * n + 114, 31)
    return date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def _observed(day: date) -> date:
    return day - timedelta(1) if day.weekday() == 5 else day + timedelta(1) if day.weekday() == 6 else day


def holidays(year: int) -> set[date]:
    """Weekdays of ``year`` on which the exchange is closed by rule."""
    days = {_nth(year, 2, 0, 3), easter(year) - timedelta(2), _nth(year, 5, 0, -1), _observed(date(year, 7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _observed(date(year, 12, 25))}
    if date(year, 1, 1).weekday() != 5:  # a Saturday's New Year is not made up for
        days.add(_observed(date(year, 1, 1)))
    if year >= 1998:
        days.add(_nth(year, 1, 0, 3))
    if year >= 2022:
        days.add(_observed(date(year, 6, 19)))
    return days | {d for d in map(date.fromisoformat, ONE_OFF) if d.year == year}


def half_days(year: int) -> set[date]:
    days = {_nth(year, 11, 3, 4) + timedelta(1), date(year, 7, 3), date(year, 12, 24)}
    return {d for d in days if d.weekday() < 5 and d not in holidays(year)}


def trading_days(first: date, last: date) -> list[tuple[date, int, int]]:
    out, day = [], first
    closed = set().union(*(holidays(y) for y in range(first.year, last.year + 1)))
    half = set().union(*(half_days(y) for y in range(first.year, last.year + 1)))
    while day <= last:
        if day.weekday() < 5 and day not in closed:
            out.append((day, OPEN, HALF_DAY if day in half else CLOSE))
        day += timedelta(1)
    return out


def calendar(spark: SparkSession, first: date = date(1990, 1, 1), last: date = date(2035, 12, 31)) -> DataFrame:
    """``(cal_date, open_min, close_min)`` of trading days: some 250 rows a year."""
    return spark.createDataFrame(trading_days(first, last), "cal_date date, open_min int, close_min int")


def with_session(df: DataFrame, cal: DataFrame, ts: str = "ts", name: str = "session") -> DataFrame:
    """``df`` with regular, premarket, afterhours or closed for New York time ``ts``."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    joined = df.join(F.broadcast(cal), F.col(ts).cast("date") == F.col("cal_date"), "left")
    session = (
        F.when(F.col("open_min").isNull(), "closed")
        .when((minute >= F.col("open_min")) & (minute < F.col("close_min")), "regular")
        .when((minute >= PREMARKET) & (minute < F.col("open_min")), "premarket")
        .when((minute >= F.col("close_min")) & (minute < AFTERHOURS), "afterhours")
        .otherwise("closed")
    )
    return joined.withColumn(name, session).drop("cal_date", "open_min", "close_min")


def label_3class(ret: Column) -> Column:
    """Below -0.5 %: SELL; below +0.5 %: HOLD; else BUY; null: null."""
    return F.when(ret < -0.005, "SELL").when(ret < 0.005, "HOLD").when(ret.isNotNull(), "BUY")


def return_between(entry: Column, later: Column) -> Column:
    return F.when(entry != 0, (later - entry) / entry)


def reliable(entry_flag: Column, next_flag: Column) -> Column:
    """Whether prices were taken right away: intraday entry and a known next open."""
    bad = entry_flag.rlike("next_day|unavailable|no_data|closed")
    return F.coalesce(~bad & entry_flag.rlike("next_bar_open|intraday") & (next_flag == "next_open_available"), F.lit(False))


def market_cap_bucket(cap: Column) -> Column:
    return F.when(cap.isNull(), "unknown").when(cap >= 200e9, "mega_cap").when(cap >= 10e9, "large_cap").when(cap >= 2e9, "mid_cap").otherwise("small_cap")


def sector(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SECTORS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, name), F.lit("Other"))


def stock_metadata(raw: DataFrame) -> DataFrame:
    """``(ticker, sector, market_cap_bucket)`` of ``(ticker, sector, market_cap)``."""
    return raw.select("ticker", sector(F.col("sector")).alias("sector"), market_cap_bucket(F.col("market_cap")).alias("market_cap_bucket"))
