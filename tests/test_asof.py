"""As-of lookups: several right sides at once, cut time lines, plans."""

import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import asof
from tidemark.operators.asof import Lookup, asof_join, asof_lookups


def best(rows, key, t, forward, strict):
    fits = [(u, n) for k, u, n in rows if key is not None and t is not None and k == key and u is not None and ((u > t if forward else u < t) or (not strict and u == t))]
    if not fits:
        return None
    edge = (min if forward else max)(u for u, _ in fits)
    return max(n for u, n in fits if u == edge)


@pytest.mark.parametrize("unit", ["minute", "hour", None])
@pytest.mark.parametrize("rows", [1, 40, 10_000])
def test_lookups_equal_brute_force_however_lines_are_cut(spark, monkeypatch, unit, rows):
    monkeypatch.setattr(asof, "FAN", 3)
    r = random.Random(rows)
    at = lambda: datetime(2025, 3, 1) + timedelta(minutes=r.randrange(3000))
    # Nine tenths of all rows have one key; some lie at equal times, some have no key or time.
    left = [(n, r.choice("aaaaaaaaab"), at()) for n in range(400)] + [(1000 + n, None, at()) for n in range(5)] + [(2000, "a", None), (2001, "z", at())]
    one = [(r.choice("aab"), at(), n) for n in range(150)] + [("a", left[0][2], 900), ("a", left[0][2], 901), (None, at(), 902), ("a", None, 903)]
    two = [(r.choice("aac"), at(), n) for n in range(4)]
    df = spark.createDataFrame(left, "id long, k string, t timestamp_ntz").repartition(5)
    first, second = (spark.createDataFrame(x, "s string, u timestamp_ntz, n long") for x in (one, two))
    how = [(first, one, True, True), (first, one, False, True), (second, two, False, False), (second, two, True, False)]
    lookups = [Lookup(x, "s", "u", forward, strict, f"p{n}_", ("n",)) for n, (x, _, forward, strict) in enumerate(how)]
    got = {x.id: x for x in asof_lookups(df, "k", "t", lookups, segment=unit, range_rows=rows).collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        for n, (_, right, forward, strict) in enumerate(how):
            assert got[i][f"p{n}_n"] == best(right, k, t, forward, strict), (i, n)


@pytest.mark.parametrize("kind", ["long", "date"])
def test_numbers_and_dates_are_cut_as_well(spark, kind):
    to = (lambda x: x) if kind == "long" else (lambda x: date(2020, 1, 1) + timedelta(x))
    left = spark.createDataFrame([(k, to(k)) for k in range(0, 300, 3)], f"id long, t {kind}").withColumn("k", F.lit("x"))
    right = spark.createDataFrame([("x", to(k), k) for k in range(0, 300, 50)], f"s string, u {kind}, n long")
    got = {x.id: x.n for x in asof_join(left, right, "k", "s", "t", "u", segment="day", range_rows=7).collect()}
    assert got == {k: (k - 1) // 50 * 50 if k else None for k in range(0, 300, 3)}


def test_ranges_hold_like_numbers_of_a_hot_symbol_year(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 10 > 0, "HOT").otherwise(F.concat(F.lit("S"), F.col("id") % 97)).alias("k"), (F.lit(datetime(2024, 1, 1)) + F.make_interval(mins=(F.col("id") * 7919 % 525_600).cast("int"))).cast("timestamp_ntz").alias("t"))
    table = asof.time_ranges(rows, "k", "t", "hour", 5_000)
    (hot,) = table.collect()
    assert hot["__k"] == "HOT" and 16 <= len(hot["starts"]) <= 19 and hot["starts"] == sorted(hot["starts"])
    in_ranges = rows.withColumnRenamed("k", "__k").withColumnRenamed("t", "__t").join(table, "__k").groupBy(asof._range_of(F.col("__t")).alias("r")).count().collect()
    assert len(in_ranges) == len(hot["starts"]) and max(x["count"] for x in in_ranges) <= 5_100
    assert asof.time_ranges(rows, "k", "t", "hour", 1_000_000) is None


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_the_flagship_shuffles_little_and_reads_each_source_once(spark, sf):
    plan = plan_of(catalog.QUERIES["flagship_dataset"](spark, sf))
    assert len(re.findall("Exchange (?:hash|Single|range|Round)", plan)) <= 6
    # Tweets, daily bars, quarter-hours: three readings of orders; the regime of each day is saved.
    assert len(re.findall("FileScan parquet|Scan parquet", plan)) <= 4


def test_a_cut_flagship_equals_the_whole_one(spark, sf, monkeypatch):
    whole = catalog.QUERIES["flagship_dataset"](spark, sf).collect()
    monkeypatch.setattr(asof.time_ranges, "__defaults__", (50,))
    monkeypatch.setattr(asof.asof_lookups, "__kwdefaults__", {"segment": None, "range_rows": 50})
    cut = catalog.QUERIES["flagship_dataset"](spark, sf)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole))
    assert len(re.findall("Exchange (?:hash|Single|range|Round)", plan_of(cut))) <= 8
