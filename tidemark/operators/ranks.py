"""Ranks and positions over a whole table, without sorting it in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import saved

#: Rows of a range, on average; ranges are as many as that takes.
RANGE_ROWS = 1_000_000


def _ranges(df: DataFrame, rows: int) -> int:
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // 10_000)), -(-rows // RANGE_ROWS))


def _bases(sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, range, base)``: rows in the ranges before, of ``(by, range, n)``; a row per range."""
    line = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.broadcast(sizes.select(*by, "range", (F.sum("n").over(line) - F.col("n")).alias("base")))


def positions(df: DataFrame, order: list[str], name: str = "position", descending: bool = False, ranges: int | None = None) -> DataFrame:
    """``df`` with 0-based positions in the order of the ``order`` columns (``descending``
    turns the first round; ties go by the rest, which should be unique).

    Rows are dealt to ranges of the whole order, ties of the first column included, and
    numbered where they lie; what comes before a range is added.
    """
    keys = [F.col(order[0]).desc() if descending else F.col(order[0]).asc(), *[F.col(c).asc() for c in order[1:]]]
    ranged = df.repartitionByRange(ranges or _ranges(df, df.count()), *keys).sortWithinPartitions(*keys)
    # The id's upper bits are the partition, the lower 33 the row in it; written once, so that
    # a task that is repeated later can't draw other ranges.
    placed = saved(ranged.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id")), "ranged")
    placed = placed.withColumn("range", F.shiftright("id", 33))
    bases = _bases(placed.groupBy("range").agg(F.count("*").alias("n")))
    place = F.col("base") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(bases, "range").select("row.*", place.alias(name))


def average_rank(df: DataFrame, column: str, name: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with 1-based ranks (within ``by``), ties sharing their mean; nulls have none."""
    counts = saved(df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("value")).agg(F.count("*").alias("c")), "values")
    dealt = counts.repartitionByRange(ranges or _ranges(df, counts.count()), *by, "value").withColumn("range", F.spark_partition_id())
    dealt = saved(dealt, "ranged")
    run = F.sum("c").over(Window.partitionBy(*by, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = dealt.withColumn("run", run).join(_bases(dealt.groupBy(*by, "range").agg(F.sum("c").alias("n")), by), [*by, "range"])
    ranked = ranked.select(*by, F.col("value").alias(column), (F.col("base") + F.col("run") - (F.col("c") - 1) / 2).alias(name))
    return df.join(ranked, [*by, column], "left")


def correlation(a: str, b: str) -> Column:
    """Pearson's, null where a side is constant (for which Spark's own raises)."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(n, ic)``: rank correlation of two columns over rows that have both."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_rank(average_rank(both, a, "__ra"), b, "__rb")
    return ranked.agg(F.count("*").alias("n"), F.coalesce(correlation("__ra", "__rb"), F.lit(0.0)).alias("ic"))


def student_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation, by the incomplete beta function's fraction."""
    from math import exp, lgamma, log

    if n < 3 or r != r or r == 0:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    x, a, b = 1 - r * r, df / 2, 0.5
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + up * d)
            c = 1 + up / c
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    value = front * f / a
    return 1 - value if swap else value


#: Steps of the continued fraction: more than it needs to settle for millions of pairs.
FRACTION = 200


def _gamma_ratio(a: Column) -> Column:
    """The logarithm of gamma(a + 1/2) / gamma(a): eight steps up, then the series in 1/x."""
    steps = reduce(lambda x, y: x * y, [(a + k) / (a + k + 0.5) for k in range(8)])
    x = a + 8
    return F.log(steps) + 0.5 * F.log(x) - 1 / (8 * x) + 1 / (192 * x * x * x) - 1 / (640 * F.pow(x, F.lit(5))) + 17 / (14336 * F.pow(x, F.lit(7)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation ``r`` of ``n`` pairs, as an expression.

    It is the incomplete beta function I_x(n/2 - 1, 1/2) at x = 1 - r^2, by its continued
    fraction, folded step by step.  Null, NaN and zero correlations and fewer than three
    pairs give 1, perfect ones 0.
    """
    r, half = r.cast("double"), (n.cast("double") - 2) / 2
    y = r * r
    front = F.exp(_gamma_ratio(half) + half * F.log(1 - y)) * F.sqrt(y / math.pi)
    swap = 1 - y > (half + 1) / (half + 2.5)
    x, a, b = F.when(swap, y).otherwise(1 - y), F.when(swap, 0.5).otherwise(half), F.when(swap, half).otherwise(F.lit(0.5))
    start = F.struct(x.alias("x"), a.alias("a"), b.alias("b"))

    def folded(v: Column) -> Column:
        x, a, b = v["x"], v["a"], v["b"]
        d = 1 / (1 - (a + b) * x / (a + 1))
        state = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("f"))

        def step(s: Column, m: Column) -> Column:
            m = m.cast("double")
            up, down = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            for e in (up, down):
                d, c = 1 / (1 + e * s["d"]), 1 + e / s["c"]
                s = F.struct(c.alias("c"), d.alias("d"), (s["f"] * c * d).alias("f"))
            return s

        return F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION)), state, step)["f"]

    # One-element arrays name what is used many times, so that it is made once.
    fraction = F.transform(F.array(start), folded)[0]
    value = front * fraction / a
    p = F.when(swap, 1 - value).otherwise(value)
    return F.when(r.isNull() | F.isnan(r) | (r == 0) | (n < 3), 1.0).when(F.abs(r) >= 1, 0.0).otherwise(p)


#: Bins of a round of selection.
BINS = 1024


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int], bins: int = BINS) -> list[float]:
    """The values at 0-based ``ranks`` of a column's sorted numbers (nulls and NaN left out).

    Each round counts ``bins`` bins of the interval that is known to hold a rank, all ranks
    at once, and narrows it to the numbers of one bin, until that has one value.  What a
    round sends to the driver are the bins of as many intervals as there are ranks.
    """
    v = F.col(column)
    values = saved(df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(v.cast("double").alias("v")), "selected")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if any(not 0 <= k < n for k in ranks):
        raise ValueError(f"no such rank among {n} numbers")
    spans = {k: (low, high, 0) for k in ranks}  # lower and upper value, numbers below
    while open_ := sorted({(lo, hi) for lo, hi, _ in spans.values() if lo < hi}):
        place, part = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (lo, hi) in enumerate(open_):
            inside = (F.col("v") >= lo) & (F.col("v") <= hi)
            # Halves, where the width of a span of huge numbers is no number.
            half = 1.0 if math.isfinite(hi - lo) else 0.5
            share = (F.col("v") * half - lo * half) / (hi * half - lo * half)
            place, part = F.when(inside, i).otherwise(place), F.when(inside, F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")).otherwise(part)
        rows = values.select(place.alias("span"), part.alias("bin"), "v").where("span is not null").groupBy("span", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        found: dict[tuple[float, float], list] = {}
        for r in sorted(rows.collect(), key=lambda r: (r["span"], r["bin"])):
            found.setdefault(open_[r["span"]], []).append(r)
        for k, (lo, hi, below) in spans.items():
            for r in found.get((lo, hi), []):
                if k < below + r["n"]:
                    spans[k] = (r["lo"], r["hi"], below)
                    break
                below += r["n"]
    return [spans[k][0] for k in ranks]


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours; None of no numbers."""
    n = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    if not n:
        return [None] * len(shares)
    at = [q * (n - 1) for q in shares]
    ranks = sorted({f(x) for x in at for f in (math.floor, math.ceil)})
    value = dict(zip(ranks, order_statistics(df, column, ranks), strict=True))
    return [value[lo] if (lo := math.floor(x)) == x else (math.ceil(x) - x) * value[lo] + (x - lo) * value[math.ceil(x)] for x in at]
