"""Shard suffixes and tables by shard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SuffixBuilder = Callable[[Column], Column]


def no_suffix() -> SuffixBuilder:
    return lambda c: F.lit("")


def mod_suffix(mod: int) -> SuffixBuilder:
    """The sign follows the number."""
    return lambda c: F.concat(F.lit("_"), (c % mod).cast("string"))


def range_suffix(size: int) -> SuffixBuilder:
    """Whole division towards zero."""
    return lambda c: F.concat(F.lit("_"), _div(c, size).cast("string"))


def _div(c: Column, size: int) -> Column:
    return F.call_function("div", c, F.lit(size))


def table_name(table: str, suffix: str) -> str:
    return f"{table}{suffix}"


def sharded_sql(sql: str, table: str, suffix: str) -> str:
    """Replaces the table's name where white space is around it."""
    return sql.replace(f" {table} ", f" {table}{suffix} ")


def with_shard(df: DataFrame, key: Column, builder: SuffixBuilder, name: str = "shard") -> DataFrame:
    return df.withColumn(name, builder(key))


def shard_views(df: DataFrame, table: str, key: Column, builder: SuffixBuilder, suffixes: list[str]) -> dict[str, DataFrame]:
    """One filtered view a suffix, registered under the shard's table name."""
    out = {}
    for s in suffixes:
        part = df.filter(builder(key) == s)
        part.createOrReplaceTempView(table_name(table, s))
        out[s] = part
    return out


def write_sharded(df: DataFrame, path: str, key: Column, builder: SuffixBuilder) -> None:
    """A folder a shard, so that a read of one shard prunes the others."""
    with_shard(df, key, builder).write.partitionBy("shard").parquet(path)
