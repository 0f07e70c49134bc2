"""Rows to transfer objects and back, and projection to a wanted schema by name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import utc_micros


def _clean(name: str) -> str:
    return name.replace("_", "").lower()


def _default(kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    return F.lit(None).cast(kind)


def project_to_schema(df: DataFrame, schema: T.StructType, tags: Mapping[str, str] | None = None) -> DataFrame:
    """Columns by name: an exact or tagged name first, else without `_` and case (the first in column order); missing ones get the type's zero value.

    A tag of "-" leaves a field out.
    """
    fuzzy: dict[str, str] = {}
    for c in df.columns:
        fuzzy.setdefault(_clean(c), c)
    out = []
    for f in schema.fields:
        wanted = (tags or {}).get(f.name, f.name)
        if wanted == "-":
            continue
        source = wanted if wanted in df.columns else fuzzy.get(_clean(wanted))
        c = _default(f.dataType) if source is None else F.col(f"`{source}`").cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def ids_from_csv(c: Column) -> Column:
    """Comma-separated ids as longs; zeros and what is none are dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("long")), lambda x: x.isNotNull() & (x != 0))


def ids_to_csv(c: Column) -> Column:
    return F.array_join(c, ",")


def to_transfer(df: DataFrame, defaults: Mapping[str, object] | None = None, times: tuple[str, ...] = (), csv_ids: tuple[str, ...] = (), nested_ids: tuple[str, ...] = ()) -> DataFrame:
    """Nulls become the default (the type's zero value), times unix nanoseconds, id lists arrays, ids struct(id)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in times:
            # a zone-less time is read as UTC
            micros = F.unix_micros(c) if isinstance(f.dataType, T.TimestampType) else utc_micros(c)
            c = F.coalesce(micros * 1000, F.lit(0).cast("long"))
        elif f.name in csv_ids:
            c = F.coalesce(ids_from_csv(c), F.expr("cast(array() as array<bigint>)"))
        elif f.name in nested_ids:
            c = F.struct(F.coalesce(c, F.lit(0)).cast("long").alias("id"))
        else:
            d = (defaults or {}).get(f.name)
            c = F.coalesce(c, _default(f.dataType) if d is None else F.lit(d).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def from_transfer(df: DataFrame, times: tuple[str, ...] = (), csv_ids: tuple[str, ...] = (), nested_ids: tuple[str, ...] = ()) -> DataFrame:
    """Empty texts and zero times become null, other zeros stay; the reverse of to_transfer."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in times:
            c = F.when(c != 0, F.timestamp_micros(F.floor(c / 1000).cast("long")))
        elif f.name in csv_ids:
            c = F.nullif(ids_to_csv(c), F.lit(""))
        elif f.name in nested_ids:
            c = c["id"]
        elif isinstance(f.dataType, T.StringType):
            c = F.nullif(c, F.lit(""))
        out.append(c.alias(f.name))
    return df.select(*out)


def params_of(row: T.Row | Mapping) -> dict:
    """A row as named parameters, without nulls."""
    items = row.asDict() if isinstance(row, T.Row) else dict(row)
    return {k: v for k, v in items.items() if v is not None}
