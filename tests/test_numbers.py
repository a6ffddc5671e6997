"""Order statistics, p-values and sketches against plain forms."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, ranks, state
from tidemark.sources.versioned import Store

SERIES = {
    "even": [float(k) for k in range(1000)],
    "skewed": [math.exp(k / 20) for k in range(-9000, 9000, 31)],
    "ties": [0.5] * 700 + [0.25] * 300 + [1.0],
    "tiny": [1e-300 * k for k in range(-50, 50)],
    "huge": [1e308, -1e308, 0.0, 1.0, 5e-324],
    "one": [7.0],
}


@pytest.mark.parametrize("bins", [64, 1024])
@pytest.mark.parametrize("name", SERIES)
def test_quantiles_equal_plain_sorting(spark, name, bins):
    v = SERIES[name]
    df = spark.createDataFrame([(x,) for x in [*v, None, float("nan")]], "v double").repartition(3)
    at = sorted({0, len(v) // 3, len(v) // 2, len(v) - 1})
    assert ranks.order_statistics(df, "v", at, bins) == [sorted(v)[k] for k in at]
    got = ranks.quantiles(df, "v", (0.0, 0.25, 0.5, 0.9, 1.0))
    assert got == pytest.approx([float(x) for x in np.percentile(np.array(v) / 4, [0, 25, 50, 90, 100]) * 4], rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert ranks.quantiles(df, "v", (0.5,)) == [None]
    with pytest.raises(ValueError, match="no such rank"):
        ranks.order_statistics(df, "v", [0])


def test_p_values_per_group_equal_the_plain_form(spark):
    rows = [(r, n) for r in (0.001, 0.034, -0.2, 0.5, -0.9, 0.999, 0.0, 1.0, -1.0, None, float("nan")) for n in (1, 2, 3, 4, 5, 10, 101, 4275, 1_000_000, 10**9)]
    got = spark.createDataFrame(rows, "r double, n long").withColumn("p", ranks.correlation_p(F.col("r"), F.col("n"))).collect()
    for x in got:
        want = ranks.student_p(x.r, x.n) if x.r is not None else 1.0
        if x.n <= 1_000_000:
            assert x.p == pytest.approx(want, rel=1e-7, abs=1e-12), x
        assert 0 <= x.p <= 1
    # A billion pairs: the normal distribution.
    assert next(x.p for x in got if x.n == 10**9 and x.r == 0.001) == pytest.approx(math.erfc(0.001 * math.sqrt(1e9 / 2)), abs=1e-9)


def test_reports_fetch_no_value_to_the_driver(spark, monkeypatch):
    rows = [(k, 0.2, 0.3, 0.5, 2, k % 3, (k % 7 - 3) / 100) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, p_sell double, p_hold double, p_buy double, pred int, label int, ret double")
    got = metrics.sweep_with_ic(df, (0.0, 0.4, 0.9)).orderBy("threshold").collect()
    assert [(x.ic, x.ic_pvalue, x.ic_significant) for x in got] == [(0.0, 1.0, False)] * 3
    train = spark.createDataFrame([(0,), (0,), (1,), (None,)], "label int")
    b = metrics.baselines(df, train).first()
    assert b.weighted_random_accuracy == pytest.approx(5 / 9) and b.naive_accuracy == pytest.approx(1 / 3) and b.majority_class == 0


def test_sketches_of_days_merge_within_two_percent(spark, tmp_path):
    at = lambda k: datetime(2024, 1, 1) + timedelta(minutes=k)
    rows = spark.range(40_000).select(F.col("id").cast("string").alias("id"), (F.lit(at(0)) + F.make_interval(mins=(F.col("id") % 14_400).cast("int"))).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).cast("string").alias("ticker"), F.when(F.col("id") % 5 > 0, F.col("id") % 3000).cast("string").alias("author"))
    rows = rows.unionByName(spark.createDataFrame([("none", None, "7", "a"), ("none", None, "7", "a")], rows.schema))
    store = Store(spark, str(tmp_path), ["day"], 4)
    for n in range(3):
        for _ in range(2):  # the second time nothing changes
            store.merge(state.daily_sketches(rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) == n)), state.merged_sketches, batch=("sync", n))
    for since, until in ((None, None), (at(1440 * 2).date(), at(1440 * 4).date()), (at(1440 * 99).date(), None)):
        part = rows
        if since:
            part = part.where(F.col("ts").cast("date") >= F.lit(since))
        if until:
            part = part.where(F.col("ts").cast("date") <= F.lit(until))
        want, got = state.table_stats(part).first(), state.sketched_stats(store.read(), since, until).first()
        assert (got.first_ts, got.last_ts) == (want.first_ts, want.last_ts)
        assert (got.n_rows, got.n_tickers) == (want.n_rows, want.n_tickers)
        assert abs(got.n_tweets - want.n_tweets) <= 0.02 * want.n_tweets and abs(got.n_authors - want.n_authors) <= 0.02 * want.n_authors
    assert state.sketched_stats(state.daily_sketches(rows.limit(0))).first().n_tweets == 0
