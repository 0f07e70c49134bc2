"""Calendar starts in UTC+8 and the usual layouts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import CST, ZONE

LAYOUTS = {
    "seconds": "yyyy-MM-dd HH:mm:ss",
    "millis": "yyyy-MM-dd HH:mm:ss.SSS",
    "minutes": "yyyy-MM-dd HH:mm",
    "day": "yyyy-MM-dd",
    "packed": "yyyyMMddHHmmss",
    "packed_millis": "yyyyMMddHHmmss.SSS",
}
UNITS = ("day", "week", "month", "year")


def nanos_of(at: datetime) -> int:
    epoch = datetime(1970, 1, 1, tzinfo=CST) + timedelta(hours=8)
    return (at - epoch) // timedelta(microseconds=1) * 1000


def start_of(at: datetime, unit: str) -> int:
    """Unix nanoseconds of the start of at's UTC+8 day, week (from Sunday), month or year."""
    t = at.astimezone(CST).replace(hour=0, minute=0, second=0, microsecond=0)
    if unit == "week":
        t -= timedelta(days=(t.weekday() + 1) % 7)
    elif unit == "month":
        t = t.replace(day=1)
    elif unit == "year":
        t = t.replace(month=1, day=1)
    elif unit != "day":
        raise ValueError(unit)
    return nanos_of(t)


def yesterday(at: datetime) -> tuple[int, int]:
    end = start_of(at, "day")
    return end - 86_400_000_000_000, end


def start_col(nanos_: Column, unit: str) -> Column:
    """As start_of, for a column of unix nanoseconds; the session's zone plays no part."""
    if unit not in UNITS:
        raise ValueError(unit)
    day_nanos, shift = 86_400_000_000_000, 8 * 3_600_000_000_000
    days = F.floor((nanos_ + shift) / F.lit(day_nanos).cast("decimal(20,0)")).cast("int")
    date = F.date_add(F.lit("1970-01-01").cast("date"), days)
    if unit == "week":
        date = F.date_sub(date, F.dayofweek(date) - 1)
    elif unit != "day":
        date = F.trunc(date, unit)
    return F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long") * day_nanos - shift


def format_cst(ts: Column, layout: str) -> Column:
    """A timestamp in UTC+8, whatever the session's zone."""
    wall = F.from_utc_timestamp(F.to_utc_timestamp(ts, F.current_timezone()), ZONE)
    return F.date_format(wall, LAYOUTS.get(layout, layout))


def utc_micros(c: Column) -> Column:
    """Microseconds since 1970 of a zone-less time that is read as UTC, by arithmetic, whatever the session's zone."""
    seconds = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECONDS"), c) * 1_000_000).cast("long")


def utc(c: Column) -> Column:
    """A zone-less time read as UTC."""
    return F.timestamp_micros(utc_micros(c))
