"""Technical indicators, once per bar, from windows over a symbol's bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RSI_DAYS = 14
#: Rows after which RSI weights start anew; (14 / 13) ** 4096 is well inside a double.
RSI_BLOCK = 4096
NUMERICAL = ["volatility_7d", "relative_volume", "rsi_14", "distance_from_ma_20", "return_5d", "return_20d", "above_ma_20", "slope_ma_20", "gap_open", "intraday_range"]


def _ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.when(b != 0, a / b)


def _line() -> Window:
    return Window.partitionBy("symbol").orderBy("bar_date")


def returns(days: int) -> Column:
    past = F.lag("close", days).over(_line())
    return _ratio(F.col("close") - past, past)


def _returned() -> Column:
    return returns(1)


def with_indicators(bars: DataFrame) -> DataFrame:
    """``bars`` and the ten indicators; each is null until it has the bars it needs.

    One row per symbol and date is assumed; a null close makes what rests on it null.
    """
    w = _line()
    i = F.row_number().over(w) - 1
    df = bars.withColumn("__i", i).withColumn("__r", _returned()).withColumn("__d", F.col("close") - F.lag("close", 1).over(w))
    df = df.withColumn("__sma", F.when(F.col("__i") >= 19, F.avg("close").over(w.rowsBetween(-19, 0))))
    before = F.lag("close", 1).over(w)
    df = df.withColumns({
        "return_5d": returns(5),
        "return_20d": returns(20),
        "volatility_7d": F.when(F.col("__i") >= 7, F.stddev_samp("__r").over(w.rowsBetween(-6, 0))),
        "relative_volume": F.when(F.col("__i") >= 20, _ratio(F.col("volume"), F.avg("volume").over(w.rowsBetween(-20, -1)))),
        "distance_from_ma_20": _ratio(F.col("close") - F.col("__sma"), F.col("__sma")),
        "above_ma_20": F.when(F.col("__sma").isNotNull(), (F.col("close") > F.col("__sma")).cast("int")),
        "slope_ma_20": _ratio(F.col("__sma"), F.lag("__sma", 5).over(w)) - 1,
        "gap_open": _ratio(F.col("open") - before, before),
        "intraday_range": _ratio(F.col("high") - F.col("low"), before),
    })
    return with_rsi(df).drop("__i", "__r", "__d", "__sma")


def with_rsi(df: DataFrame) -> DataFrame:
    """Wilder's RSI in closed form: a ratio of two sums with weights (14 / 13) ** k.

    Sums run in blocks of ``RSI_BLOCK`` bars; a block inherits its forerunner's sums, which
    counts to the last bit of a double.  Needs ``__i`` and ``__d`` (the day's change).
    """
    k = F.col("__i") % RSI_BLOCK
    weight = F.pow(F.lit(RSI_DAYS / (RSI_DAYS - 1)), k)
    df = df.withColumn("__b", F.floor(F.col("__i") / RSI_BLOCK)).withColumn("__u", F.greatest("__d", F.lit(0.0)) * weight).withColumn("__a", F.abs("__d") * weight)
    run = Window.partitionBy("symbol", "__b").orderBy("bar_date").rowsBetween(Window.unboundedPreceding, 0)
    before = _line().rowsBetween(Window.unboundedPreceding, -1)
    fade = (RSI_DAYS / (RSI_DAYS - 1)) ** -RSI_BLOCK
    df = df.withColumn("__su", F.sum("__u").over(run)).withColumn("__sa", F.sum("__a").over(run)).withColumn("__end", k == RSI_BLOCK - 1)
    df = df.withColumns({f"__p{x}": F.last(F.when(F.col("__end"), F.coalesce(f"__s{x}", F.lit(0.0)) * fade), ignorenulls=True).over(before) for x in "ua"})
    up, all_ = (F.col(f"__s{x}") + F.coalesce(f"__p{x}", F.lit(0.0)) for x in "ua")
    return df.withColumn("rsi_14", F.when(F.col("__i") >= RSI_DAYS, _ratio(100 * up, all_))).drop("__b", "__u", "__a", "__su", "__sa", "__pu", "__pa", "__end")


#: The regime's thresholds.
TRENDING, VOLATILE = 0.02, 0.18


def with_regime(bars: DataFrame) -> DataFrame:
    """``(bar_date, regime_return, regime_volatility, market_regime)`` of an index's bars."""
    w = _line()
    df = bars.withColumn("__i", F.row_number().over(w) - 1).withColumn("__r", _returned()).withColumn("regime_return", returns(5))
    df = df.withColumn("regime_volatility", F.when(F.col("__i") >= 4, F.stddev_samp("__r").over(w.rowsBetween(-3, 0)) * F.sqrt(F.lit(252.0))))
    return df.select("symbol", "bar_date", "regime_return", "regime_volatility", regime(F.col("regime_return"), F.col("regime_volatility")).alias("market_regime"))


def regime(ret: Column, vol: Column) -> Column:
    return F.when(vol > VOLATILE, "volatile").when(ret > TRENDING, "trending_up").when(ret < -TRENDING, "trending_down").otherwise("calm")
