"""As-of joins as one union, one shuffle and a sorted pass in each direction, for any number
of right sides at once.

Left rows and the rows of all right sides are laid out in time order per key.  A pass upwards
gives each left row the last row before it of every backward lookup, a pass downwards the
first row after it of every forward one.

A key that holds very many left rows has its time line cut into ranges of like numbers of
rows, chosen from counts.  What a range inherits (of each backward lookup the last row of
earlier ranges, of each forward one the first row of later ranges) is added to it as rows,
from a table of one row per such key and range; nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, MapType, NumericType

from ..scratch import saved

#: Left rows of a key from which on its time line is cut, and of a range of it.
RANGE_ROWS = 1_000_000
#: Starts of ranges that are searched at once.
FAN = 64
#: Starts of ranges (some 10 bytes each) up to which their table is broadcast.
BROADCAST_STARTS = 200_000
#: Parts that rows without a key or a time are dealt to; they match nothing.
LOST = 1024


@dataclass(frozen=True)
class Lookup:
    """What is looked up: the last row of ``right`` before a time, or the first one after it.

    Strict: equal times don't match.  Columns are named ``prefix + name``; ``columns``
    chooses among those of ``right`` (None: all but ``by``).
    """

    right: DataFrame
    by: str
    time: str | Column
    forward: bool = False
    strict: bool = True
    prefix: str = ""
    columns: tuple[str, ...] | None = None

    @property
    def names(self) -> list[str]:
        return [c for c in self.right.columns if c != self.by] if self.columns is None else list(self.columns)


def _col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def _later(time: Column, kind) -> Column:
    """A number that falls as ``time`` rises."""
    if isinstance(kind, NumericType):
        return -time
    return -F.unix_date(time) if isinstance(kind, DateType) else -F.unix_micros(time.cast("timestamp"))


def time_ranges(left: DataFrame, by: str, time: str, grain: str, rows: int = RANGE_ROWS) -> DataFrame | None:
    """``(__k, starts, outer)`` for keys of more than ``rows`` rows; None where there are none.

    Ranges begin where a ``grain`` begins, and end with the grain in which they are full;
    ``outer`` has every ``FAN``-th start.  Times that are numbers are cut anywhere.
    """
    lines = left.select(F.col(f"`{by}`").cast("string").alias("__k"), F.col(f"`{time}`").alias("__t")).where("__k is not null and __t is not null")
    full = saved(lines.groupBy("__k").agg(F.count("*").alias("n")).where(F.col("n") > rows).select("__k"), "full-keys")
    if full.isEmpty():
        return None
    kind = lines.schema["__t"].dataType
    start = F.col("__t") if isinstance(kind, NumericType) else F.date_trunc(grain, "__t").cast(kind)
    counts = lines.join(full, "__k", "left_semi").groupBy("__k", start.alias("start")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__k").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    firsts = counts.withColumn("number", F.floor(before / rows)).groupBy("__k", "number").agg(F.min("start").alias("start"))
    starts = firsts.groupBy("__k").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    return saved(starts.withColumn("outer", F.filter("starts", lambda _, i: i % FAN == 0)), "time-ranges")


def _range_of(time: Column) -> Column:
    """The number of a key's range that holds ``time``; 0 where the key has no ranges."""
    high = F.greatest(F.size(F.filter("outer", lambda s: s <= time)) - 1, F.lit(0)) * FAN
    low = F.size(F.filter(F.slice("starts", high + 1, F.lit(FAN)), lambda s: s <= time))
    return F.when(F.col("starts").isNull(), 0).otherwise(F.greatest(high + low - 1, F.lit(0)))


def asof_lookups(left: DataFrame, by: str, time: str, lookups: Sequence[Lookup], *, segment: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``left`` with the columns of its as-of row of each lookup.

    Left rows without a match keep nulls; null keys or times never match.  Of right rows with
    equal key and time, the one that comes last in the order of their values is taken.
    ``segment`` (``hour``, ``day``, ...) lets keys of more than ``range_rows`` left rows be cut
    where such a unit begins, which counts the left keys first.
    """
    kind = left.schema[time].dataType
    held = [F.col(f"`{c}`") for c in left.columns]
    ranges = time_ranges(left, by, time, segment, range_rows) if segment else None
    if ranges is not None:
        total = ranges.agg(F.sum(F.size("starts"))).first()[0]
        ranges = F.broadcast(ranges) if total <= BROADCAST_STARTS else ranges

    def placed(rows: DataFrame) -> DataFrame:
        if ranges is None:
            return rows.withColumn("__r", F.lit(0))
        return rows.join(ranges, "__k", "left").withColumn("__r", _range_of(F.col("__t"))).drop("starts", "outer")

    kinds = [x.right.select(F.struct(*[F.col(f"`{c}`") for c in x.names]).alias("p")).schema["p"].dataType for x in lookups]
    lefts = placed(left.select(F.col(f"`{by}`").cast("string").alias("__k"), F.col(f"`{time}`").alias("__t"), F.struct(*held).alias("__l")))
    hashed = [F.col(f"`{f.name}`") for f in left.schema.fields if not isinstance(f.dataType, MapType)]
    lost = F.col("__k").isNull() | F.col("__t").isNull()
    lefts = lefts.withColumn("__r", F.when(lost, -1 - F.pmod(F.xxhash64(*[F.col("__l").getField(f.name) for f in left.schema.fields if not isinstance(f.dataType, MapType)]), F.lit(LOST)).cast("int")).otherwise(F.col("__r")) if hashed else F.col("__r"))
    lefts = lefts.select("__k", "__r", "__t", F.lit(1).alias("__o"), "__l", *[F.lit(None).cast(t).alias(f"__p{n}") for n, t in enumerate(kinds)])

    def events(right: DataFrame, own: list[int]) -> DataFrame:
        """The rows of one right side, once for each lookup in it."""
        where = [F.struct(_col(lookups[n].time).cast(kind).alias("__t"), F.lit(2 if lookups[n].strict else 0).alias("__o"), F.lit(n).alias("__n"), F.col(f"`{lookups[n].by}`").cast("string").alias("__k")) for n in own]
        rows = right.select(F.explode(F.array(*where)).alias("__e"), *right.columns) if len(own) > 1 else right.select(where[0].alias("__e"), *right.columns)
        payload = [F.when(F.col("__e.__n") == n, F.struct(*[F.col(f"`{c}`") for c in lookups[n].names])) if n in own else F.lit(None).cast(kinds[n]) for n in range(len(lookups))]
        rows = rows.select(F.col("__e.__k").alias("__k"), F.col("__e.__t").alias("__t"), F.col("__e.__o").alias("__o"), *[p.alias(f"__p{n}") for n, p in enumerate(payload)])
        return rows.where("__k is not null and __t is not null")

    sides: dict[int, list[int]] = {}
    for n, x in enumerate(lookups):
        sides.setdefault(id(x.right), []).append(n)
    rights = reduce(DataFrame.unionByName, [events(lookups[own[0]].right, own) for own in sides.values()])
    if ranges is not None:
        rights = saved(rights, "right-sides")
    rights = placed(rights)
    every = ["__k", "__r", "__t", "__o", *[f"__p{n}" for n in range(len(lookups))]]
    if ranges is not None:
        rights = rights.select(every).unionByName(_inherited(rights, ranges, lookups, kind).select(every))
    both = lefts.unionByName(rights.withColumn("__l", F.lit(None).cast(lefts.schema["__l"].dataType)))

    line = Window.partitionBy("__k", "__r").rowsBetween(Window.unboundedPreceding, 0)
    ties = [F.col(f"__p{n}").asc_nulls_first() for n in range(len(lookups))]
    found = {f"__m{n}": F.last(f"__p{n}", ignorenulls=True).over(line.orderBy(F.col("__t").desc() if x.forward else F.col("__t").asc(), "__o", *ties)) for n, x in enumerate(lookups)}
    out = both.withColumns(found).where("__o = 1")
    matched = [F.when(~lost, F.col(f"__m{n}")).getField(c).alias(x.prefix + c) for n, x in enumerate(lookups) for c in x.names]
    return out.select("__l.*", *matched)


def _inherited(rights: DataFrame, ranges: DataFrame, lookups: Sequence[Lookup], kind) -> DataFrame:
    """For each range of a cut key the right rows that earlier and later ranges leave it."""
    cut = rights.join(ranges.select("__k"), "__k", "left_semi")
    ends = []
    for n, x in enumerate(lookups):
        key = F.struct((_later(F.col("__t"), kind) if x.forward else F.col("__t")).alias("at"), F.col(f"__p{n}").alias("p"))
        ends.append(F.max(F.when(F.col(f"__p{n}").isNotNull(), F.struct(key.alias("key"), F.col("__t").alias("t"), F.col("__o").alias("o")))).alias(f"__e{n}"))
    each = ranges.select("__k", F.explode(F.sequence(F.lit(0), F.size("starts") - 1)).alias("__r"))
    table = each.join(cut.groupBy("__k", "__r").agg(*ends), ["__k", "__r"], "left")
    line = Window.partitionBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    left = [F.last(f"__e{n}", ignorenulls=True).over(line.orderBy(F.col("__r").desc() if x.forward else F.col("__r").asc())).alias(f"__e{n}") for n, x in enumerate(lookups)]
    table = table.select("__k", "__r", *left)
    payload = lambda n: F.col(f"__e{n}.key.p")
    rows = [F.struct(F.col(f"__e{n}.t").alias("__t"), F.col(f"__e{n}.o").alias("__o"), *[(payload(m) if m == n else F.lit(None).cast(rights.schema[f"__p{m}"].dataType)).alias(f"__p{m}") for m in range(len(lookups))]) for n in range(len(lookups))]
    return table.select("__k", "__r", F.explode(F.array(*rows)).alias("e")).where("e.__t is not null").select("__k", "__r", "e.*")


def asof_join(left: DataFrame, right: DataFrame, left_by: str, right_by: str, left_time: str, right_time: str, *, forward: bool = False, strict: bool = True, prefix: str = "", segment: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``left`` with the columns of its as-of row of ``right``, as in ``asof_lookups``."""
    return asof_lookups(left, left_by, left_time, [Lookup(right, right_by, right_time, forward, strict, prefix)], segment=segment, range_rows=range_rows)
