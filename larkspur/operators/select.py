"""Queries to lazy DataFrames: join, filter, count, order, page, project, in this order."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ir import Join, Keyset, Order, Page, Query
from .predicates import IDENTIFIER, QueryError, column, where


class Result(NamedTuple):
    """The page, and the number of all rows as one row (column `count`) where it was asked for. Both are lazy."""

    page: DataFrame
    total: DataFrame | None


def resolver(join: Join | None):
    """Names to columns: under a join a plain name is of t, and one that starts with the join's alias of t1."""
    if join is None:
        return column
    alias = join.alias if join.alias.endswith(".") else join.alias + "."
    if not IDENTIFIER.match(alias[:-1]):
        raise QueryError("a join needs an alias")

    def resolve(name: str) -> Column:
        if not IDENTIFIER.match(name):
            raise QueryError(f"not a column name: {name!r}")
        if name.startswith(alias):
            return F.col("t1." + name[len(alias) :])
        if "." in name:
            raise QueryError(f"unknown alias in {name!r}")
        return F.col("t." + name)

    return resolve


def orders(items, resolve=column) -> list[Column]:
    """Ascending puts nulls last and descending first, as row stores do."""
    out = []
    for item in items:
        how = (item.order or "asc").strip().lower()
        if how not in ("asc", "desc"):
            raise QueryError(f"unknown order {item.order!r}")
        c = resolve(item.name)
        out.append(c.asc_nulls_last() if how == "asc" else c.desc_nulls_first())
    return out


def left_join(left: DataFrame, right: DataFrame, join: Join) -> DataFrame:
    """Equi-join; the optimizer takes the physical way by the sides' sizes."""
    resolve = resolver(join)
    return left.alias("t").join(right.alias("t1"), resolve(join.col) == resolve(join.other_col), "left")


def limited(df: DataFrame, page: Page) -> DataFrame:
    return df.offset(page.index * page.size).limit(page.size) if page.index else df.limit(page.size)


def build_query(
    source: SparkSession | Mapping[str, DataFrame], table: str, columns: str, query: Query, max_page_size: int = 100, join: Join | None = None
) -> Result:
    """`source` names tables: a session's views, or a mapping of frames. `columns` is a comma list of names.

    Under an order, the primary key is added as its last part, so pages do not overlap.
    """
    find = source.table if isinstance(source, SparkSession) else source.__getitem__
    join = join or query.join
    resolve = resolver(join)
    rows = find(table)
    pk = query.pk or "id"
    rows = rows.alias("t") if join is None else left_join(rows, find(join.table), join)
    rows = where(rows, query.conditions, resolve)
    total = rows.agg(F.count(resolve(pk)).alias("count")) if query.return_total else None
    if query.orders:
        by = orders(query.orders, resolve)
        has_pk = pk in find(table).columns
        if has_pk and pk not in [o.name for o in query.orders]:
            by.append(resolve(pk).asc_nulls_last())
        rows = rows.orderBy(*by)
    if query.page is not None:
        rows = limited(rows, query.page.clamped(max_page_size))
    names = [c.strip() for c in columns.split(",") if c.strip()]
    return Result(rows.select("*" if names == ["*"] else [resolve(c) for c in names]), total)


def total(df: DataFrame, pk: str = "id") -> DataFrame:
    return df.agg(F.count(column(pk)).alias("count"))


def append_limit(df: DataFrame, page: Page, max_page_size: int) -> DataFrame:
    """A page of any frame: size 0 is unlimited, below 0 or too large is the largest."""
    size = max_page_size if page.size < 0 or page.size > max_page_size else page.size
    return limited(df, Page(size, page.index)) if size else df


def keyset(df: DataFrame, page: Keyset, name: str = "id", max_page_size: int = 100) -> DataFrame:
    """The rows after last_id, by id. The filter is a range of the key, so deep pages cost no more than the first."""
    size = Page(page.size).clamped(max_page_size).size
    return df.filter(column(name) > F.lit(page.last_id)).orderBy(column(name)).limit(size)


def top(df: DataFrame, by: list[Order], n: int) -> DataFrame:
    return df.orderBy(*orders(by)).limit(n)
