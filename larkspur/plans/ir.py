"""The declarative query: typed values, optional conditions, ordering, paging, one left join, updates."""

from __future__ import annotations

import enum
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

DEFAULT_PAGE_SIZE = 30


class ValueType(enum.IntEnum):
    NONE = 0
    INT = 1
    DOUBLE = 2
    STRING = 3
    BOOL = 4
    TIME = 5
    STRING_ARRAY = 6
    INT_ARRAY = 7
    DOUBLE_ARRAY = 8
    TIME_ARRAY = 9
    STATUS = 10
    STATUSES = 11
    PG_INT_ARRAY = 12
    PG_STRING_ARRAY = 13
    PG_DOUBLE_ARRAY = 14


def time_of(nanos: int) -> datetime:
    """Unix nanoseconds as a UTC timestamp, floored to the microsecond that Spark keeps."""
    micros = nanos // 1000
    return datetime.fromtimestamp(micros // 1_000_000, timezone.utc).replace(microsecond=micros % 1_000_000)


@dataclass(frozen=True)
class Value:
    """A tagged value. `resolved` is None where a condition on it is to be left out."""

    kind: ValueType
    data: object = None

    def resolved(self, operator: str = "=") -> object | None:
        k, v = self.kind, self.data
        if v is None:
            return None
        if k is ValueType.INT:
            return int(v)
        if k is ValueType.DOUBLE:
            return float(v)
        if k is ValueType.STRING:
            return f"%{v}%" if operator.strip().lower() == "like" else str(v)
        if k is ValueType.BOOL:
            return bool(v)
        if k is ValueType.TIME:
            return time_of(v) if v else None
        if k is ValueType.STATUS:
            return int(v) if v > 0 else None
        if k is ValueType.TIME_ARRAY:
            return [time_of(x) for x in v if x]
        if k in (ValueType.STRING_ARRAY, ValueType.INT_ARRAY, ValueType.DOUBLE_ARRAY, ValueType.STATUSES, ValueType.PG_INT_ARRAY, ValueType.PG_STRING_ARRAY, ValueType.PG_DOUBLE_ARRAY):
            return list(v)
        return None

    @staticmethod
    def _array(kind: ValueType, values: Sequence | None) -> Value | None:
        return Value(kind, tuple(values)) if values else None

    @staticmethod
    def string_array(values):
        return Value._array(ValueType.STRING_ARRAY, values)

    @staticmethod
    def int_array(values):
        return Value._array(ValueType.INT_ARRAY, values)

    @staticmethod
    def double_array(values):
        return Value._array(ValueType.DOUBLE_ARRAY, values)

    @staticmethod
    def time_array(nanos):
        return Value._array(ValueType.TIME_ARRAY, nanos)

    @staticmethod
    def statuses(values):
        return Value._array(ValueType.STATUSES, values)

    @staticmethod
    def string(value: str, skip_empty: bool = False):
        return None if skip_empty and not value else Value(ValueType.STRING, value)

    @staticmethod
    def int(value: int, skip_empty: bool = False):
        return None if skip_empty and not value else Value(ValueType.INT, value)

    @staticmethod
    def double(value: float, skip_empty: bool = False):
        return None if skip_empty and not value else Value(ValueType.DOUBLE, value)

    @staticmethod
    def time(nanos: int):
        return Value(ValueType.TIME, nanos) if nanos else None

    @staticmethod
    def bool(value: bool):
        return Value(ValueType.BOOL, value)

    @staticmethod
    def status(value: int):
        return Value(ValueType.STATUS, value)

    @staticmethod
    def pg_int_array(values):
        return Value(ValueType.PG_INT_ARRAY, tuple(values))

    @staticmethod
    def pg_string_array(values):
        return Value(ValueType.PG_STRING_ARRAY, tuple(values))

    @staticmethod
    def pg_double_array(values):
        return Value(ValueType.PG_DOUBLE_ARRAY, tuple(values))


@dataclass(frozen=True)
class Condition:
    col: str
    operator: str
    value: Value | None


@dataclass(frozen=True)
class Order:
    name: str
    order: str = "asc"


@dataclass(frozen=True)
class Page:
    size: int = 0
    index: int = 0

    def clamped(self, most: int) -> Page:
        """No size is the default size, none is above `most`, no index below 0."""
        size = DEFAULT_PAGE_SIZE if self.size <= 0 else self.size
        return Page(min(size, most), max(self.index, 0))


@dataclass(frozen=True)
class Join:
    """Left join `table` on t.`col` = `other_col`, which names the joined table by `alias` (such as "u.")."""

    table: str
    col: str
    other_col: str
    alias: str


@dataclass(frozen=True)
class Query:
    conditions: tuple[Condition, ...] = ()
    orders: tuple[Order, ...] = ()
    page: Page | None = None
    return_total: bool = False
    force_page: bool = False
    join: Join | None = None
    pk: str = ""

    def with_(self, **changes) -> Query:
        return replace(self, **changes)


@dataclass(frozen=True)
class Field:
    col: str
    value: Value | None


@dataclass(frozen=True)
class Update:
    id: int
    fields: tuple[Field, ...] = ()
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Keyset:
    """A keyset page: rows after `last_id`, by id."""

    last_id: int = 0
    size: int = 0
    number: int = 0
    return_total: bool = False


class RangeType(enum.IntEnum):
    ALL = 0
    MINUTE = 1
    MINUTE_N = 2
    HOUR = 3
    DAY = 4
    WEEK = 5
    MONTH = 6
    YEAR = 7


@dataclass(frozen=True)
class TimeRange:
    """A statistics range: unix nanoseconds, half open."""

    kind: RangeType
    start: int = 0
    end: int = 0
    interval: int = 1


@dataclass
class StatisticsTask:
    id: int = 0
    task: str = ""
    start: int = 0
    end: int = 0
    status: int = 0
    message: str = ""
    create_time: int = 0
    update_time: int = 0


@dataclass
class Params:
    """URL parameters of one request, last value of a name wins; see plans.params."""

    values: dict[str, str] = field(default_factory=dict)
