"""Time-sortable 64-bit identifiers: milliseconds since EPOCH, index, node and data centre."""

from __future__ import annotations

import threading
import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the layout.
EPOCH = 1444281954363
INDEX_BITS, NODE_BITS, DC_BITS = 10, 5, 3
LOW_BITS = 18
LOW_MASK = 262143
ZONE = "+08:00"
CST = timezone(timedelta(hours=8))


def pack(ms: Column, index: Column, node: Column, dc: Column) -> Column:
    low = F.shiftleft(index, NODE_BITS + DC_BITS).bitwiseOR(F.shiftleft(node, DC_BITS)).bitwiseOR(dc)
    return F.shiftleft((ms - EPOCH).cast("long"), LOW_BITS).bitwiseOR(low.cast("long"))


def created_ms(id_: Column) -> Column:
    return F.shiftright(id_, LOW_BITS) + EPOCH


def parse(id_: Column) -> Column:
    """struct(id, createTimeMS, nodeID, index, dcID)."""
    return F.struct(
        id_.alias("id"),
        created_ms(id_).alias("createTimeMS"),
        F.shiftright(id_, DC_BITS).bitwiseAND(F.lit(31)).alias("nodeID"),
        F.shiftright(id_, NODE_BITS + DC_BITS).bitwiseAND(F.lit(1023)).alias("index"),
        id_.bitwiseAND(F.lit(7)).alias("dcID"),
    )


def to_time(id_: Column) -> Column:
    return F.timestamp_millis(created_ms(id_))


def least(nanos: int) -> int:
    """The smallest id of the millisecond of a time."""
    return (nanos // 1_000_000 - EPOCH) << LOW_BITS


def most(nanos: int) -> int:
    return least(nanos) | LOW_MASK


def between(id_: Column, start_nanos: int, end_nanos: int) -> Column:
    """Ids made from one time to another (milliseconds, both included): a range of the id column itself, which scans can prune by."""
    return id_.between(F.lit(least(start_nanos)), F.lit(most(end_nanos)))


def to_no(id_: Column) -> Column:
    """Readable number: UTC+8 time to the millisecond, then the inverted low bits in base 36."""
    local = F.from_utc_timestamp(to_utc_wall(id_), ZONE)
    low = F.upper(F.conv(F.bitwise_not(id_).bitwiseAND(F.lit(LOW_MASK)).cast("string"), 10, 36))
    return F.when(id_.isNotNull(), F.concat(F.date_format(local, "yyyyMMddHHmmssSSS"), low))


def to_utc_wall(id_: Column) -> Column:
    """The creation time whose wall clock in the session's zone reads as UTC."""
    return F.to_utc_timestamp(to_time(id_), F.current_timezone())


def from_no(no: Column) -> Column:
    """The id of a readable number; 0 if it is none."""
    digits = F.substring(no, 1, 17)
    seconds = F.try_to_timestamp(F.concat(F.substring(digits, 1, 14), F.lit("."), F.substring(digits, 15, 3)), F.lit("yyyyMMddHHmmss.SSS"))
    # the text is a UTC+8 wall clock, whatever the session's zone
    ms = F.unix_millis(F.from_utc_timestamp(seconds, F.current_timezone())) - 8 * 3_600_000
    tail = F.substring(no, 18, 10)
    low = F.conv(tail, 36, 10).cast("long")
    valid = no.rlike(r"^[0-9]{17}[0-9A-Za-z]{1,4}\z") & seconds.isNotNull() & (low <= LOW_MASK)
    id_ = F.shiftleft((ms - EPOCH).cast("long"), LOW_BITS).bitwiseOR(F.bitwise_not(low).bitwiseAND(F.lit(LOW_MASK)))
    return F.when(no.isNull(), None).when(F.coalesce(valid, F.lit(False)), id_).otherwise(F.lit(0).cast("long"))


def with_ids(df: DataFrame, name: str, now_ms: int, dc: int = 0) -> DataFrame:
    """Adds unique ids without a shuffle: partition number as node (and time), row number inside as index (and time).

    Each partition owns every 32nd slot of milliseconds from now_ms on, so ids never meet however
    many rows a partition has.
    """
    if not 0 <= dc < 1 << DC_BITS:
        raise ValueError("dc must be below 8")
    own = F.monotonically_increasing_id()
    part, row = F.shiftright(own, 33), own.bitwiseAND(F.lit((1 << 33) - 1))
    node = part.bitwiseAND(F.lit(31))
    # each group of 32 partitions takes a stretch of its own: 2**33 rows need 2**23 milliseconds
    ms = F.lit(now_ms) + F.shiftleft(F.shiftright(part, 5), 23) + F.shiftright(row, INDEX_BITS)
    return df.withColumn(name, pack(ms, row.bitwiseAND(F.lit(1023)), node, F.lit(dc).cast("long")))


class Generator:
    """One node's ids on the driver; waits for the next millisecond after 1024 and never goes back in time."""

    def __init__(self, dc: int, node: int, clock=lambda: time.time_ns() // 1_000_000):
        if not 0 <= dc <= 7 or not 0 <= node <= 31:
            raise ValueError("dc must lie in 0 .. 7 and node in 0 .. 31")
        self.dc, self.node, self.clock = dc, node, clock
        self.last, self.index, self.lock = -1, 0, threading.Lock()

    def next_id(self) -> int:
        with self.lock:
            now = max(self.clock(), self.last)
            self.index = self.index + 1 if now == self.last else 0
            if self.index > 1023:
                now, self.index = self.last + 1, 0
            self.last = now
            return ((now - EPOCH) << LOW_BITS) | (self.index << 8) | (self.node << 3) | self.dc


def format_sequence(layout: str, id_: Column) -> Column:
    """The UTC+8 time in a Java layout, then the hexadecimal id; 0 gives an empty text."""
    from .ids import hex_encode

    local = F.from_utc_timestamp(to_utc_wall(id_), ZONE)
    return F.when(id_ == 0, "").otherwise(F.concat(F.date_format(local, layout), hex_encode(id_)))


def parse_id(id_: int) -> dict[str, int]:
    return {"id": id_, "createTimeMS": (id_ >> LOW_BITS) + EPOCH, "nodeID": id_ >> 3 & 31, "index": id_ >> 8 & 1023, "dcID": id_ & 7}


def time_of(id_: int) -> datetime:
    return datetime.fromtimestamp(((id_ >> LOW_BITS) + EPOCH) / 1000, CST)
