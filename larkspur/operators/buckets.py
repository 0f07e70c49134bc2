"""Calendar buckets of timestamps and their boundaries."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import nanos_of
from ..functions.sequence import CST
from ..plans.ir import RangeType, TimeRange
from .predicates import QueryError

UNITS = {
    RangeType.MINUTE: "MINUTE",
    RangeType.HOUR: "HOUR",
    RangeType.DAY: "DAY",
    RangeType.WEEK: "WEEK",
    RangeType.MONTH: "MONTH",
    RangeType.YEAR: "YEAR",
}


def bucket(c: Column, kind: RangeType, interval: int = 1, week_start: str = "monday", ntz: bool = True) -> Column:
    """The start of c's bucket. MINUTE_N's grid begins anew every hour. ntz: the result has no zone, as c."""
    if kind is RangeType.MINUTE_N:
        if interval < 1:
            raise QueryError("the interval must be 1 at least")
        minutes = (F.floor(F.minute(c) / interval) * interval).cast("int")
        out = F.date_trunc("HOUR", c) + F.make_interval(mins=minutes)
    elif kind is RangeType.WEEK and week_start == "sunday":
        out = F.date_trunc("DAY", c) - F.make_interval(days=F.dayofweek(c) - 1)
    elif kind in UNITS:
        out = F.date_trunc(UNITS[kind], c)
    else:
        raise QueryError("no range type")
    return out.cast("timestamp_ntz") if ntz else out


def counts_by(df: DataFrame, c: Column, kind: RangeType, interval: int = 1, week_start: str = "monday") -> DataFrame:
    return df.groupBy(bucket(c, kind, interval, week_start).alias("bucket")).agg(F.count("*").alias("n"))


def boundaries(r: TimeRange, week_start: str = "sunday") -> list[int]:
    """Unix nanoseconds: the start as it is, then UTC+8 aligned points until one reaches the end."""
    out = [r.start]
    if r.kind is RangeType.ALL or r.kind not in RangeType:
        return out
    if r.interval < 1 and r.kind is RangeType.MINUTE_N:
        raise QueryError("the interval must be 1 at least")
    while out[-1] < r.end:
        out.append(_next(out[-1], r, week_start))
    return out


def _next(at: int, r: TimeRange, week_start: str) -> int:
    t = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=at // 1000)
    t = t.astimezone(CST)
    day = t.replace(hour=0, minute=0, second=0, microsecond=0)
    if r.kind is RangeType.MINUTE:
        t = t.replace(second=0, microsecond=0) + timedelta(minutes=1)
    elif r.kind is RangeType.MINUTE_N:
        t = t.replace(second=0, microsecond=0) + timedelta(minutes=r.interval)
    elif r.kind is RangeType.HOUR:
        t = t.replace(minute=0, second=0, microsecond=0) + timedelta(hours=1)
    elif r.kind is RangeType.DAY:
        t = day + timedelta(days=1)
    elif r.kind is RangeType.WEEK:
        back = (t.weekday() + 1) % 7 if week_start == "sunday" else t.weekday()
        t = day + timedelta(days=7 - back)
    elif r.kind is RangeType.MONTH:
        t = day.replace(year=t.year + t.month // 12, month=t.month % 12 + 1, day=1)
    else:
        t = day.replace(year=t.year + 1, month=1, day=1)
    return nanos_of(t)
