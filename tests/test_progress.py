"""Observed counts, bucketed bars, prices looked up anew."""

import random
import re
from datetime import date, datetime, timedelta

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.functions import market
from tidemark.operators.indicators import with_indicators
from tidemark.operators.validate import recomputed_prices
from tidemark.plans import landed_queries as Q
from tidemark.plans.enrich import enriched
from tidemark.plans.progress import Progress, observed
from tidemark.scratch import scratch_path
from tidemark.sources import sinks
from tidemark.sources import tables as S
from tidemark.streaming.ingest import sync_landed


def test_rows_without_a_price_are_counted_in_the_pass_that_writes(spark, sf, tmp_path):
    t, meta, cal = S.tweets(spark, sf).withColumn("category", F.lit("c")), S.metadata(spark, sf), market.calendar(spark, date(1995, 1, 1), date(2002, 1, 1))
    make = lambda **how: enriched(t, S.daily_bars(spark, sf), S.intraday_bars(spark, sf), S.market_bars(spark, sf), meta, cal, **how)
    seen = Observation("enriched")
    make(observation=seen).write.parquet(f"{tmp_path}/out")
    every = make(filter_reliable=False, skip_missing=False)
    assert seen.get["rows"] == every.count() == t.count()
    assert seen.get["without_price"] == every.where("entry_price is null").count() > 0
    assert seen.get["unreliable"] == every.where("not is_reliable_label").count()
    assert observed(t, None) is t


def test_a_listener_tells_of_each_batch(spark, sf, tmp_path):
    heard = []
    listener = Progress(heard.append)
    spark.streams.addListener(listener)
    try:
        path = scratch_path(spark, "landing")
        Q.land_days(spark, sf, path, 1)
        query = sync_landed(spark, path, f"{tmp_path}/store", f"{tmp_path}/cp")
        query.awaitTermination()
        stored = spark.read.parquet(f"{tmp_path}/store/raw").count()
        for _ in range(100):
            if any("ended" in x for x in heard):
                break
            spark.range(1).count()
    finally:
        spark.streams.removeListener(listener)
    batches = [x for x in heard if x.get("batch") is not None and x["counts"]]
    assert sum(x["counts"]["landed"]["rows"] for x in batches) == stored
    assert [x["error"] for x in heard if "ended" in x] == [None]


def test_bucketed_bars_are_read_without_a_shuffle(spark, sf):
    bars = sinks.write_bar_table(S.daily_bars(spark, sf), "bars_of_a_test", scratch_path(spark, "bars"), 4)
    out = with_indicators(bars)
    out.collect()
    assert not re.search("Exchange", out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, with_indicators(S.daily_bars(spark, sf)).collect()), key=repr)
    spark.sql("DROP TABLE bars_of_a_test")


def test_planted_errors_in_prices_are_found(spark):
    r = random.Random(5)
    at = lambda d, m: datetime(2024, 1, 1) + timedelta(days=d, minutes=m)
    intraday = [(s, at(d, m), float(r.randrange(1, 1000))) for s in "AB" for d in (3, 4, 70, 200) for m in (570, 585, 600)]
    daily = [(s, at(d, 0).date(), float(r.randrange(1, 1000))) for s in "AB" for d in (3, 4, 70, 71, 200)]
    rows = []
    for n in range(300):
        ts, s, session = at(r.randrange(-40, 230), r.randrange(1440)), r.choice("ABC"), r.choice(["regular", "closed"])
        soon = min(((t, o) for k, t, o in intraday if k == s and t > ts), default=(None, None))[1]
        later = min(((d, o) for k, d, o in daily if k == s and d > ts.date()), default=(None, None))[1]
        entry = soon if session != "closed" and soon is not None else later
        rows.append((ts, s, session, (entry or 0.0) + 1.0 if n % 10 == 0 else entry, None if n % 15 == 0 else later))
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, ticker string, session string, entry_price double, price_next_open double")
    bars = spark.createDataFrame(intraday, "symbol string, bar_ts timestamp_ntz, open double"), spark.createDataFrame(daily, "symbol string, bar_date date, open double")
    got = {x.price: (x.n_rows, x.n_bad) for x in recomputed_prices(df, bars[1], bars[0]).collect()}
    lost = sum(n % 15 == 0 and any(k == s and d > ts.date() for k, d, _ in daily) for n, (ts, s, *_) in enumerate(rows))
    assert got == {"entry_price": (300, 30), "price_next_open": (300, lost)} and lost > 5
    assert [x.n_rows for x in recomputed_prices(df.limit(0), bars[1], bars[0]).collect()] == [0, 0]
