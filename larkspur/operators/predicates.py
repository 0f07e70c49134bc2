"""Optional conditions as column expressions: incomplete ones are left out, the rest must all hold."""

from __future__ import annotations

import functools
import operator as op
import re
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ir import Condition, ValueType

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?\Z")
Resolver = Callable[[str], Column]


class QueryError(ValueError):
    pass


def column(name: str) -> Column:
    """A column by a plain or once dotted name; anything else is an error, never SQL text."""
    if not IDENTIFIER.match(name):
        raise QueryError(f"not a column name: {name!r}")
    return F.col(name)


COMPARISONS: dict[str, Callable] = {
    "=": op.eq, "==": op.eq, "<>": op.ne, "!=": op.ne, "<": op.lt, "<=": op.le, ">": op.gt, ">=": op.ge,
    "like": F.like, "not like": lambda c, v: ~F.like(c, v),
}


def _literal(value, zoneless: bool) -> Column:
    """A value as it compares with the column: a time beside a zone-less column is its UTC wall clock, so that the range reaches the scan."""
    if zoneless and isinstance(value, datetime):
        return F.expr(f"timestamp_ntz'{value.astimezone(timezone.utc).replace(tzinfo=None).isoformat(sep=' ')}'")
    return F.lit(value)


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


ARRAYS: dict[str, Callable] = {
    "&&": lambda c, v: F.arrays_overlap(c, _array(v)),
    "@>": lambda c, v: functools.reduce(op.and_, [F.array_contains(c, F.lit(x)) for x in v], F.lit(True)),
    "<@": lambda c, v: F.forall(c, lambda x: x.isin(*v)),
    "=": lambda c, v: c == _array(v),
    "= any": lambda c, v: c.isin(*v),
}
PG = (ValueType.PG_INT_ARRAY, ValueType.PG_STRING_ARRAY, ValueType.PG_DOUBLE_ARRAY)


def predicate(condition: Condition, resolve: Resolver = column, zoneless: Callable[[str], bool] = lambda name: False) -> Column | None:
    """None where the condition is to be left out: no name, operator or value, or a value that stands for any. zoneless: which columns have times without a zone."""
    if not condition or not condition.col or not condition.operator or condition.value is None:
        return None
    how = " ".join(condition.operator.lower().split())
    value = condition.value.resolved(how)
    if value is None:
        return None
    target = resolve(condition.col)
    bare = condition.value.kind in (ValueType.TIME, ValueType.TIME_ARRAY) and zoneless(condition.col)
    if condition.value.kind in PG:
        if how not in ARRAYS:
            raise QueryError(f"unknown array operator {condition.operator!r}")
        return ARRAYS[how](target, value)
    if how in ("in", "not in"):
        values = value if isinstance(value, list) else [value]
        if not values:
            return None
        values = [_literal(v, bare) for v in values]
        return target.isin(*values) if how == "in" else ~target.isin(*values)
    if how not in COMPARISONS:
        raise QueryError(f"unknown operator {condition.operator!r}")
    if isinstance(value, list):
        raise QueryError(f"{condition.operator!r} does not take a list")
    return COMPARISONS[how](target, _literal(value, bare))


def conjunction(conditions: Iterable[Condition], resolve: Resolver = column, zoneless: Callable[[str], bool] = lambda name: False) -> Column | None:
    found = [p for c in conditions if (p := predicate(c, resolve, zoneless)) is not None]
    return functools.reduce(op.and_, found) if found else None


def where(df: DataFrame, conditions: Iterable[Condition], resolve: Resolver = column) -> DataFrame:
    def zoneless(name: str) -> bool:
        return isinstance(df.select(resolve(name)).schema[0].dataType, T.TimestampNTZType)

    both = conjunction(conditions, resolve, zoneless)
    return df if both is None else df.filter(both)


def by_id(df: DataFrame, value: int, name: str = "id") -> DataFrame:
    return df.filter(column(name) == F.lit(value))
