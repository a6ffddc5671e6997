"""Checks of an enriched dataset, as tables of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import market
from .indicators import with_indicators


def violations(df: DataFrame) -> DataFrame:
    """``(check, n_rows, n_bad)``: label, return, hash, session and price rules."""
    ret = market.return_between(F.col("entry_price"), F.col("price_next_open"))
    rules = {
        "label_matches_return": ~F.col("label_1d_3class").eqNullSafe(market.label_3class(F.col("return_to_next_open"))),
        "return_matches_prices": F.abs(F.col("return_to_next_open") - ret) > 1e-9,
        "hash_matches_text": ~F.col("tweet_hash").eqNullSafe(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 12)),
        "session_is_known": ~F.coalesce(F.col("session").isin("regular", "premarket", "afterhours", "closed"), F.lit(False)),
        "prices_are_positive": (F.col("entry_price") <= 0) | (F.col("price_next_open") <= 0),
        "reliable_has_prices": F.col("is_reliable_label") & (F.col("entry_price").isNull() | F.col("price_next_open").isNull()),
        "next_open_is_later": F.col("hours_to_next_open") <= 0,
    }
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col("n").alias("n_rows"), F.col(k).alias("n_bad")) for k in rules])).alias("x")).select("x.*")


def phase_zero(df: DataFrame) -> DataFrame:
    """``(check, value, passed)``: no class above 70 %, labels and reliability above 50 %."""
    labels = df.where("label_1d_3class is not null").groupBy("label_1d_3class").agg(F.count("*").alias("n"))
    top = labels.agg((F.max("n") / F.sum("n")).alias("v")).select(F.lit("largest_class").alias("check"), "v", (F.col("v") < 0.7).alias("passed"))
    share = lambda name, c: df.agg(F.avg(c.cast("int")).alias("v")).select(F.lit(name).alias("check"), "v", (F.col("v") > 0.5).alias("passed"))
    parts = [top, share("has_label", F.col("label_1d_3class").isNotNull()), share("reliable", F.col("is_reliable_label"))]
    return reduce(DataFrame.unionByName, parts).select("check", F.col("v").alias("value"), "passed")


def recomputed(stored: DataFrame, bars: DataFrame, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """``(indicator, n_rows, n_bad)``: stored indicators that differ from those of the bars.

    ``stored`` has ``symbol, bar_date``; null and a number differ, two nulls don't.
    """
    anew = with_indicators(bars).select("symbol", "bar_date", *[F.col(c).alias(f"__{c}") for c in columns])
    both = stored.join(anew, ["symbol", "bar_date"])
    differs = lambda c: F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")) > tolerance, F.col(c).isNull() != F.col(f"__{c}").isNull())
    counts = both.agg(F.count("*").alias("n"), *[F.count_if(differs(c)).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col("n").alias("n_rows"), F.col(c).alias("n_bad")) for c in columns])).alias("x")).select("x.*")


#: Halvings of a search: lines of up to a million bars.
HALVINGS = 20


def bar_lines(bars: DataFrame, time: str, first: Column | None = None) -> DataFrame:
    """``(symbol, month, line, after)``: a month's ``(t, open)`` in order, and the next one.

    Months without bars up to a symbol's last one are there too, from ``first`` on; a line is
    as long as a month has quarters of an hour at most.
    """
    b = bars.where("symbol is not null").select("symbol", F.struct(F.col(time).cast("timestamp_ntz").alias("t"), "open").alias("b")).where("b.t is not null")
    lines = b.groupBy("symbol", F.trunc(F.col("b.t").cast("date"), "month").alias("month")).agg(F.sort_array(F.collect_list("b")).alias("line"))
    w = Window.partitionBy("symbol").orderBy("month")
    lines = lines.withColumns({"before": F.lag("month").over(w), "after": F.lead(F.get("line", F.lit(0))).over(w)})
    start = F.coalesce(F.add_months("before", 1), F.least(F.trunc(first, "month"), F.col("month")) if first is not None else F.col("month"))
    each = lines.withColumn("m", F.explode(F.sequence(start, F.col("month"), F.expr("interval 1 month"))))
    own = F.col("m") == F.col("month")
    return each.select("symbol", F.col("m").cast("date").alias("month"), F.when(own, F.col("line")).otherwise(F.slice("line", 1, F.lit(0))).alias("line"), F.when(own, F.col("after")).otherwise(F.get("line", F.lit(0))).alias("after"))


def first_after(line: Column, after: Column, ts: Column) -> Column:
    """The first ``(t, open)`` of a sorted line that is later than ``ts``, by halving it."""

    def half(s: Column, _: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        later = F.get(line, mid)["t"] > ts
        return F.when(lo >= hi, s).when(later, F.struct(lo.alias("lo"), mid.alias("hi"))).otherwise(F.struct((mid + 1).alias("lo"), hi.alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.size(line).alias("hi"))
    at = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, half)["lo"]
    return F.coalesce(F.get(line, at), after)


def recomputed_prices(dataset: DataFrame, daily: DataFrame, intraday: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``(price, n_rows, n_bad)``: entry prices and next opens that differ from the bars'.

    ``dataset`` has ``timestamp`` (New York wall clock), ``ticker``, ``session`` and both
    prices.  They are looked up anew in lines of bars per symbol and month, by halving, which
    shares nothing with the join that made them.  Null and a number differ, two nulls don't.
    """
    rows = dataset.select("ticker", "session", "entry_price", "price_next_open", F.col("timestamp").cast("timestamp_ntz").alias("ts"))
    rows = rows.withColumn("month", F.trunc(F.col("ts").cast("date"), "month"))
    earliest = rows.agg(F.min("ts")).first()[0]
    first = F.lit(earliest).cast("date") if earliest is not None else None
    for bars, time, name in ((intraday, "bar_ts", "soon"), (daily, "bar_date", "later")):
        lines = bar_lines(bars, time, first).select(F.col("symbol").alias("ticker"), "month", "line", "after")
        rows = rows.join(lines, ["ticker", "month"], "left")
        rows = rows.withColumn(name, first_after(F.col("line"), F.col("after"), F.col("ts"))["open"]).drop("line", "after")
    want = {"entry_price": F.when((F.col("session") != "closed") & F.col("soon").isNotNull(), F.col("soon")).otherwise(F.col("later")), "price_next_open": F.col("later")}
    differs = {c: F.coalesce(F.abs(F.col(c) - w) > tolerance, F.col(c).isNull() != w.isNull()) for c, w in want.items()}
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(d).alias(c) for c, d in differs.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("price"), F.col("n").alias("n_rows"), F.col(c).alias("n_bad")) for c in want])).alias("x")).select("x.*")
