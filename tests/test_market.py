"""Sessions, entry prices, look-ahead, indicators, clocks and as-of joins on small cases."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import market, timezones
from tidemark.operators.asof import asof_join
from tidemark.operators.indicators import NUMERICAL, with_indicators, with_regime
from tidemark.plans.enrich import OUTPUT, enriched, with_entry_price

DAILY = "symbol string, bar_date date, open double, high double, low double, close double, volume long"


def daily(spark, change=None):
    days = pd.bdate_range("2024-12-01", "2025-01-20")
    rows = [("AAPL", d.date(), 100 + 0.5 * i, 101 + 0.5 * i, 99 + 0.5 * i, 100.5 + 0.5 * i, 1_000_000 + 10_000 * i) for i, d in enumerate(days)]
    return spark.createDataFrame([change(r) if change else r for r in rows], DAILY)


def intraday(spark):
    rows = [("AAPL", datetime(2025, 1, 15, 4) + timedelta(minutes=15 * i), 100 + 0.1 * i) for i in range(65)]
    return spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, open double")


def tweets(spark, *times):
    return spark.createDataFrame([(i, t, "AAPL", "author", "earnings", "Test tweet", "u") for i, t in enumerate(times)], "id long, ts timestamp_ntz, ticker string, author string, category string, text string, tweet_url string")


@pytest.mark.parametrize(("ret", "label"), [(-0.006, "SELL"), (-0.005, "HOLD"), (0.0, "HOLD"), (0.004, "HOLD"), (0.005, "BUY"), (0.01, "BUY"), (None, None)])
def test_labels(spark, ret, label):
    df = spark.createDataFrame([(ret,)], "r double")
    assert df.select(market.label_3class(F.col("r"))).first()[0] == label


def test_sessions_and_half_days(spark):
    times = {"2025-01-15 10:30": "regular", "2025-01-15 09:29": "premarket", "2025-01-15 09:30": "regular", "2025-01-15 16:00": "afterhours", "2025-01-15 08:00": "premarket", "2025-01-15 17:00": "afterhours", "2025-01-15 23:00": "closed", "2025-01-18 10:00": "closed", "2024-12-25 10:00": "closed", "2024-11-29 12:59": "regular", "2024-11-29 13:00": "afterhours"}
    df = spark.createDataFrame([(datetime.fromisoformat(t), s) for t, s in times.items()], "ts timestamp_ntz, want string")
    for r in market.with_session(df, market.calendar(spark)).collect():
        assert r.session == r.want, r


def test_holidays():
    closed = market.holidays(2024) | market.holidays(2025)
    assert {date(2024, 12, 25), date(2024, 11, 28), date(2025, 4, 18), date(2025, 1, 9)} <= closed
    assert date(2025, 1, 15) not in closed and date(2021, 12, 31) not in market.holidays(2021)


def entry(spark, t, bars=None, days=None):
    df = market.with_session(tweets(spark, t), market.calendar(spark)).withColumn("et_date", F.col("ts").cast("date"))
    return with_entry_price(df, days or daily(spark), bars or intraday(spark)).first()


def test_entry_prices(spark):
    r = entry(spark, datetime(2025, 1, 15, 10, 0))
    assert r.entry_price == pytest.approx(100 + 0.1 * 25) and r.entry_price_flag == "regular_next_bar_open"  # the 10:15 bar
    days = spark.createDataFrame([("AAPL", date(2025, 1, d), o, o, o, o, 1) for d, o in ((10, 100.0), (13, 101.0), (14, 102.0))], DAILY)
    r = entry(spark, datetime(2025, 1, 12, 20, 0), days=days)
    assert (r.entry_price, r.entry_price_flag) == (101.0, "closed_next_day_open")
    days = spark.createDataFrame([("AAPL", date(2025, 1, d), o, o, o, o, 1) for d, o in ((15, 100.0), (16, 101.0))], DAILY)
    r = entry(spark, datetime(2025, 1, 15, 17, 0), bars=intraday(spark).where("bar_ts <= timestamp_ntz'2025-01-15 15:45:00'"), days=days)
    assert (r.entry_price, r.entry_price_flag) == (101.0, "afterhours_next_day_open")
    r = entry(spark, datetime(2025, 1, 15, 4, 30), days=days)
    assert r.price_next_open == 101.0
    r = entry(spark, datetime(2025, 1, 20, 10, 0), days=days)
    assert (r.entry_price, r.entry_price_flag, r.price_next_open_flag) == (None, "no_data_available", "next_open_unavailable")


def dataset(spark, days, **how):
    meta = spark.createDataFrame([("AAPL", "Technology", 3e12)], "ticker string, sector string, market_cap double")
    spy = days.withColumn("symbol", F.lit("SPY"))
    return enriched(tweets(spark, datetime(2025, 1, 15, 10, 30), datetime(2024, 12, 1, 10, 0)), days, intraday(spark), spy, meta, market.calendar(spark), **how)


def test_nothing_of_the_day_itself_is_seen(spark):
    plain = dataset(spark, daily(spark)).first()
    poisoned = dataset(spark, daily(spark, lambda r: r if r[1] < date(2025, 1, 15) else (*r[:3], 9999.99, 1.0, 9999.99, 7))).first()
    for c in [*NUMERICAL, "market_regime", "session"]:
        assert plain[c] == poisoned[c] and plain[c] is not None, c
    assert plain.sector == "Technology" and plain.market_cap_bucket == "mega_cap"
    assert plain.hours_to_next_open == pytest.approx(13.5)


def test_dataset_shape_and_empty_input(spark):
    out = dataset(spark, daily(spark), filter_reliable=False, skip_missing=False)
    assert out.columns == ["id", *OUTPUT]
    flags = {r.id: (r.entry_price_flag, r.is_reliable_label) for r in out.collect()}
    assert flags == {0: ("regular_next_bar_open", True), 1: ("no_data", False)}
    empty = dataset(spark, daily(spark).limit(0))
    assert empty.columns == ["id", *OUTPUT] and empty.collect() == []


def test_indicators_equal_pandas(spark):
    r = np.random.default_rng(1)
    n = 60
    close = 100 + np.cumsum(r.normal(size=n))
    rows = [("X", date(2024, 1, 1) + timedelta(i), float(close[i] + 0.1), float(close[i] + 1), float(close[i] - 1), float(close[i]), int(1000 + i)) for i in range(n)]
    got = with_indicators(spark.createDataFrame(rows, DAILY)).orderBy("bar_date").toPandas()
    c, v = pd.Series(close), pd.Series(np.arange(1000, 1000 + n), dtype=float)
    sma, d = c.rolling(20).mean(), c.diff()
    up, down = (x.ewm(alpha=1 / 14, min_periods=14).mean() for x in (d.clip(lower=0), (-d).clip(lower=0)))
    want = {
        "return_5d": c.pct_change(5), "return_20d": c.pct_change(20), "volatility_7d": c.pct_change().rolling(7).std(), "relative_volume": v / v.rolling(20).mean().shift(1),
        "rsi_14": 100 * up / (up + down), "distance_from_ma_20": c / sma - 1, "slope_ma_20": sma / sma.shift(5) - 1, "gap_open": (c + 0.1) / c.shift(1) - 1, "intraday_range": 2 / c.shift(1),
    }
    for name, series in want.items():
        assert got[name].to_numpy(float) == pytest.approx(series.to_numpy(), abs=1e-9, nan_ok=True), name
    regime = with_regime(spark.createDataFrame(rows, DAILY)).orderBy("bar_date").toPandas()
    vol = c.pct_change().rolling(4).std() * 252**0.5
    assert regime.regime_volatility.to_numpy(float) == pytest.approx(vol.to_numpy(), abs=1e-9, nan_ok=True)


def test_rsi_of_a_long_series(spark):
    r = np.random.default_rng(2)
    close = 100 + np.cumsum(r.normal(size=9000))
    rows = [("X", date(2000, 1, 1) + timedelta(i), 1.0, 1.0, 1.0, float(x), 1) for i, x in enumerate(close)]
    got = with_indicators(spark.createDataFrame(rows, DAILY)).orderBy("bar_date").toPandas().rsi_14.to_numpy(float)
    d = pd.Series(close).diff()
    up, all_ = (x.ewm(alpha=1 / 14, min_periods=14).mean() for x in (d.clip(lower=0), d.abs()))
    assert got == pytest.approx((100 * up / all_).to_numpy(), abs=1e-8, nan_ok=True)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("segment", [None, "day"])
def test_asof_equals_brute_force(spark, forward, strict, segment):
    r = random.Random(7)
    at = lambda: datetime(2025, 1, 1) + timedelta(minutes=r.randrange(4000))
    left = [(i, r.choice("ab") if i else None, at() if i != 1 else None) for i in range(120)]
    right = list({(k, t): (k, t, n) for n, (k, t) in enumerate((r.choice("abc"), at()) for _ in range(60))}.values()) + [(None, at(), 99), ("a", None, 98)]
    got = {x.id: x.n for x in asof_join(spark.createDataFrame(left, "id long, k string, t timestamp_ntz"), spark.createDataFrame(right, "s string, u timestamp_ntz, n long"), "k", "s", "t", "u", forward=forward, strict=strict, segment=segment).collect()}
    for i, k, t in left:
        fits = [(u, n) for s, u, n in right if k and t and s == k and u and ((u > t if forward else u < t) or (not strict and u == t))]
        assert got[i] == ((min if forward else max)(fits)[1] if fits else None), i


def test_clocks(spark):
    df = spark.createDataFrame([("a", datetime(2025, 11, 2, 1, 30)), ("b", datetime(2025, 3, 9, 2, 30)), ("c", datetime(2025, 1, 15, 10, 30)), ("d", datetime(2025, 7, 15, 10, 0))], "symbol string, bar_ts timestamp_ntz")
    got = {r.symbol: r.t for r in timezones.normalized_bars(df).select("symbol", F.col("bar_ts").cast("string").alias("t")).collect()}
    assert got == {"b": "2025-03-09 07:00:00", "c": "2025-01-15 15:30:00", "d": "2025-07-15 14:00:00"}
    text = spark.createDataFrame([("Wed Jan 15 15:30:00 +0000 2025",), ("nonsense",)], "x string")
    assert [r[0] for r in text.select(timezones.eastern_text(F.col("x"))).collect()] == ["2025-01-15 10:30:00-0500", "nonsense"]
