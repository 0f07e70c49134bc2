"""URL parameters to a Query. Parsing happens on the driver; nothing is spliced into SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from urllib.parse import parse_qsl

from ..functions.ids import hex_decode
from ..functions.sequence import EPOCH
from .ir import Condition, Order, Page, Query, Value, ValueType

TIME_FORMAT = "%Y-%m-%d %H:%M:%S"
INT = re.compile(r"[+-]?[0-9]+\Z")
MOST, LEAST = 2**63 - 1, -(2**63)


class ParameterError(ValueError):
    pass


@dataclass(frozen=True)
class FieldDefined:
    """How one parameter becomes a condition; `convert` (params, key) -> Value or None replaces the parsing by kind."""

    col: str
    operator: str
    kind: ValueType
    convert: Callable[[Mapping[str, str], str], Value | None] | None = None


def params_of(url: str) -> dict[str, str]:
    """The query part of a URL, or such a part itself; of a repeated name the first value."""
    out: dict[str, str] = {}
    for k, v in parse_qsl(url.partition("?")[2] if "?" in url else url, keep_blank_values=True):
        out.setdefault(k, v)
    return out


def _int(text: str, strict: bool = False) -> int:
    if not INT.match(text):
        if strict:
            raise ParameterError(text)
        return 0
    n = int(text)
    if not LEAST <= n <= MOST and strict:
        raise ParameterError(text)
    return max(LEAST, min(MOST, n))


def int_param(params: Mapping[str, str], key: str) -> int:
    return _int(params.get(key, ""))


def bool_param(params: Mapping[str, str], key: str) -> bool:
    return params.get(key, "") in ("true", "1")


def time_param(params: Mapping[str, str], key: str, layout: str = TIME_FORMAT, tz: timezone = timezone.utc) -> datetime | None:
    """None where it is missing; an error where it can't be read."""
    text = params.get(key, "")
    if not text:
        return None
    try:
        return datetime.strptime(text, layout).replace(tzinfo=tz)
    except ValueError as e:
        raise ParameterError(text) from e


def parse_page(params: Mapping[str, str], offset: int = 0) -> Page:
    return Page(int_param(params, "page_size"), max(int_param(params, "page_index") - offset, 0))


def parse_orders(params: Mapping[str, str], fields: Mapping[str, FieldDefined], compat_sort: bool = False) -> tuple[Order, ...]:
    """Keyset order by start_id, then `sort=a,b` with sort_a=asc|desc. compat_sort leaves the latter out."""
    out = []
    if (defined := fields.get("start_id")) is not None:
        zero = int_param(params, "start_id") == 0
        if defined.operator == "<":
            out += [Order(defined.col, "desc")] if zero else []
        elif not zero:
            out.append(Order(defined.col, "asc" if defined.operator == ">" else "desc"))
    for name in params.get("sort", "").split(",") if not compat_sort else ():
        way = params.get(f"sort_{name}", "").lower()
        if name in fields and way in ("asc", "desc"):
            out.append(Order(fields[name].col, way))
    return tuple(out)


def parse_conditions(params: Mapping[str, str], fields: Mapping[str, FieldDefined], initial: Iterable[Condition] = (), tz: timezone = timezone.utc) -> tuple[Condition, ...]:
    out = list(initial)
    for key, defined in fields.items():
        text = params.get(key, "")
        if text in ("", "null", "undefined"):
            continue
        if defined.convert is not None:
            value = defined.convert(params, key)
        else:
            value = _value(defined.kind, text, tz)
        if value is not None:
            out.append(Condition(defined.col, defined.operator, value))
    return tuple(out)


def _value(kind: ValueType, text: str, tz: timezone) -> Value | None:
    if kind is ValueType.INT:
        return Value(kind, _int(text, strict=True))
    if kind is ValueType.STATUS:
        n = _int(text, strict=True)
        return Value(kind, n) if n > 0 else None
    if kind in (ValueType.INT_ARRAY, ValueType.STATUSES):
        numbers = tuple(_int(x) for x in text.split(",") if x)
        return Value(kind, numbers) if numbers else None
    if kind is ValueType.DOUBLE:
        try:
            return Value(kind, float(text))
        except ValueError as e:
            raise ParameterError(text) from e
    if kind is ValueType.BOOL:
        return None if text == "_all" else Value(kind, text in ("true", "1"))
    if kind is ValueType.TIME:
        at = time_param({"": text}, "", tz=tz)
        whole = (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(seconds=1)
        return Value(kind, whole * 1_000_000_000)
    if kind is ValueType.STRING:
        return Value(kind, text)
    raise ParameterError(f"no parameter can be of kind {kind.name}")


def parse_query(params: Mapping[str, str], fields: Mapping[str, FieldDefined], offset: int = 0, initial: Iterable[Condition] = (), compat_sort: bool = False) -> Query:
    return Query(
        conditions=parse_conditions(params, fields, initial),
        orders=parse_orders(params, fields, compat_sort),
        page=parse_page(params, offset),
        return_total=bool_param(params, "return_total"),
    )


def id_text(value: str, now_ms: int) -> str:
    """An id that may be hexadecimal or decimal, as decimal: hexadecimal if that lies within three years of now."""
    if len(value) > 15:
        return value
    n = hex_decode(value)
    if n == 0 or abs(now_ms - ((n >> 18) + EPOCH)) > 3 * 365 * 86_400_000:
        n = _int(value)
    return str(n)


def remote_ip(headers: Mapping[str, str], peer: str = "") -> str:
    """The first address that a proxy names, else the peer's."""
    low = {k.lower(): v for k, v in headers.items()}
    for name in ("x-forwarded-for", "x-real-ip"):
        if first := low.get(name, "").split(",")[0].strip():
            return first
    return peer
