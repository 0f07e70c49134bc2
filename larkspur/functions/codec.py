"""Codecs between values and bytes, and expiring envelopes."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ids


@dataclass(frozen=True)
class Coder:
    """A pair of column functions."""

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


BYTES = Coder(lambda c: c, lambda c: c)
STRING = Coder(lambda c: F.encode(c, "UTF-8"), lambda c: F.decode(c, "UTF-8"))
INT64 = Coder(ids.bytes_be, ids.int_be)
UINT64 = Coder(lambda c: F.unhex(F.lpad(F.conv(c.cast("decimal(20,0)").cast("string"), 10, 16), 16, "0")), lambda c: F.when(F.length(c) == 8, ids.uint_be(c)))
INT32 = Coder(lambda c: ids.bytes_be(c, 4), ids.int32_be)
UINT32 = Coder(lambda c: ids.bytes_be(c, 4), lambda c: F.when(F.length(c) == 4, ids.uint_be(c).cast("long")))


def json(schema: str) -> Coder:
    return Coder(lambda c: F.encode(F.to_json(c), "UTF-8"), lambda c: F.from_json(F.decode(c, "UTF-8"), schema))


def protobuf(message: type, schema: str) -> Coder:
    """Messages as structs of their plain fields, in Arrow batches; `message` is a generated class."""
    names = [f.name for f in message.DESCRIPTOR.fields]

    @F.pandas_udf("binary")
    def encode(rows: pd.DataFrame) -> pd.Series:
        return rows.apply(lambda r: message(**{k: v for k, v in r.items() if v is not None}).SerializeToString(), axis=1)

    @F.pandas_udf(schema)
    def decode(data: pd.Series) -> pd.DataFrame:
        parsed = [message.FromString(bytes(b)) for b in data]
        return pd.DataFrame([{n: getattr(m, n) for n in names} for m in parsed], columns=names)

    return Coder(encode, decode)


def envelope(data: Column, expires_nanos: Column) -> Column:
    """struct(data, exp), exp in unix nanoseconds."""
    return F.struct(data.alias("data"), expires_nanos.cast("long").alias("exp"))


def live(cell: Column, now_nanos: Column | int) -> Column:
    """The data of an envelope that has not expired, else null."""
    now = now_nanos if isinstance(now_nanos, Column) else F.lit(now_nanos)
    return F.when(cell["exp"] >= now, cell["data"])


def live_all(cell: Column, now_nanos: Column | int) -> Column:
    """As `live`, for struct(datas, exp)."""
    now = now_nanos if isinstance(now_nanos, Column) else F.lit(now_nanos)
    return F.when(cell["exp"] >= now, cell["datas"])
