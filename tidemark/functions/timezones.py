"""New York time: wall clock, instants and the two hours that clocks shift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "America/New_York"


def to_instant(naive: Column) -> Column:
    """The instant of a New York wall-clock time (session time zone UTC)."""
    return F.to_utc_timestamp(naive.cast("timestamp"), ZONE)


def to_eastern(instant: Column) -> Column:
    return F.from_utc_timestamp(instant, ZONE)


def bar_instant(naive: Column) -> Column:
    """The instant of a bar's New York time: times of the skipped hour move to its end, times
    of the hour that happens twice are null, for they name no instant."""
    wall = naive.cast("timestamp")
    first = F.to_utc_timestamp(wall, ZONE)
    gap = to_eastern(first) != wall
    twice = to_eastern(first + F.expr("interval 1 hour")) == wall
    moved = F.to_utc_timestamp(F.date_trunc("hour", to_eastern(first)), ZONE)
    return F.when(~twice, F.when(gap, moved).otherwise(first))


def normalized_bars(bars: DataFrame, ts: str = "bar_ts") -> DataFrame:
    """``bars`` with ``ts`` as an instant; those of the hour that happens twice go."""
    instant = bar_instant(F.col(ts))
    return bars.where(instant.isNotNull()).withColumn(ts, instant)


def api_time(text: Column) -> Column:
    """``Wed Dec 17 15:01:11 +0000 2025`` as an instant; null if it is none."""
    return F.try_to_timestamp(F.substring(text, F.lit(5), F.lit(100)), F.lit("MMM dd HH:mm:ss Z yyyy"))


def eastern_text(text: Column) -> Column:
    """An API time as New York text with its offset; other texts unchanged."""
    t = api_time(text)
    local = to_eastern(t)
    hours = ((F.unix_micros(local) - F.unix_micros(t)) / 3.6e9).cast("int")
    offset = F.format_string("%s%02d00", F.when(hours < 0, "-").otherwise("+"), F.abs(hours))
    return F.coalesce(F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), offset), text)


def stored_time(text: Column) -> Column:
    """An instant of text with an offset, of text without one (UTC) or in ISO form."""
    forms = ("yyyy-MM-dd HH:mm:ssZ", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def calendar_days(duration: Column) -> Column:
    """Days of ``1 Y``, ``6M``, ``30 D`` and the like; 200 where it can't be read."""
    text = F.upper(F.trim(duration))
    n, unit = F.regexp_extract(text, r"^(\d+)\s*([SDWMY])$", 1), F.regexp_extract(text, r"^(\d+)\s*([SDWMY])$", 2)
    n = n.try_cast("long")
    return F.when(unit == "Y", n * 365).when(unit == "M", n * 30).when(unit == "W", n * 7).when(unit == "D", n).when(unit == "S", F.greatest(F.lit(1), F.floor(n / 86400))).otherwise(200).cast("long")


def trading_days(duration: Column) -> Column:
    days = calendar_days(duration)
    return (days - 2 * F.floor(days / 7)).cast("long")
