"""An ordered key-value table: (key binary, value binary), compared as unsigned bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import bytes_be

SEPARATOR = "\t\t\t"


def storage_key(*parts: Column) -> Column:
    """Parts joined by the separator, as bytes."""
    sep = F.lit(SEPARATOR).cast("binary")
    out = parts[0].cast("binary")
    for p in parts[1:]:
        out = F.concat(out, sep, p.cast("binary"))
    return out


def id_key(prefix: str, id_: Column) -> Column:
    """Prefix, separator, big-endian id: sorts by id."""
    return F.concat(F.lit(prefix + SEPARATOR).cast("binary"), bytes_be(id_))


def id_of_key(prefix: str, key: Column) -> Column:
    from ..functions.ids import int_be

    n = len((prefix + SEPARATOR).encode())
    return int_be(F.substring(key, n + 1, 8))


def upper_bound(prefix: bytes) -> bytes | None:
    """The first key after all with the prefix; None where there is none."""
    bare = prefix.rstrip(b"\xff")
    return bare[:-1] + bytes([bare[-1] + 1]) if bare else None


def scan(df: DataFrame, start: bytes | None = None, end: bytes | None = None, reverse: bool = False, most: int = 0, ordered: bool = True) -> DataFrame:
    """Keys from start (included) to end (not), in order. Bounds are range filters that reach the scan; a limit makes it a top-n.

    A caller that takes all keys in any order says ordered=False and is spared the sort.
    """
    if start is not None:
        df = df.filter(F.col("key") >= F.lit(bytearray(start)))
    if end is not None:
        df = df.filter(F.col("key") < F.lit(bytearray(end)))
    if ordered or most > 0:
        df = df.orderBy(F.col("key").desc() if reverse else F.col("key").asc())
    return df.limit(most) if most > 0 else df


def scan_prefix(df: DataFrame, prefix: bytes, reverse: bool = False, most: int = 0, ordered: bool = True) -> DataFrame:
    return scan(df, prefix, upper_bound(prefix), reverse, most, ordered)


def each(rows: DataFrame, handler: Callable[[bytes, bytes], bool]) -> int:
    """Calls handler(key, value) in order, a partition at a time in memory, until it returns False; how many calls."""
    n = 0
    for row in rows.select("key", "value").toLocalIterator():
        n += 1
        if handler(bytes(row.key), bytes(row.value)) is False:
            break
    return n


def get(df: DataFrame, key: bytes) -> bytes | None:
    row = df.filter(F.col("key") == F.lit(bytearray(key))).select("value").first()
    return None if row is None else bytes(row.value)


def put(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with rows set; an empty key is an error."""
    from .dml import upsert

    key = F.when(F.octet_length("key") > 0, F.col("key")).otherwise(F.raise_error(F.lit("a key must not be empty")))
    return upsert(df, rows.select(key.alias("key"), "value"), ["key"])


def delete(df: DataFrame, key: bytes) -> DataFrame:
    return df.filter(F.col("key") != F.lit(bytearray(key)))


def delete_range(df: DataFrame, start: bytes, end: bytes) -> DataFrame:
    return df.filter(~((F.col("key") >= F.lit(bytearray(start))) & (F.col("key") < F.lit(bytearray(end)))))


def encoded(df: DataFrame, coder) -> DataFrame:
    return df.withColumn("value", coder.encode(F.col("value")))


def decoded(df: DataFrame, coder) -> DataFrame:
    return df.withColumn("value", coder.decode(F.col("value")))
