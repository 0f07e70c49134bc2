"""Identifiers, addresses and bytes as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 2**63 - 1


def hex_encode(c: Column) -> Column:
    """Lower-case hexadecimal; a negative number has a sign."""
    low = F.lower(F.hex(F.abs(c)))
    return F.when(c == F.lit(-MOST - 1), "-8000000000000000").when(c < 0, F.concat(F.lit("-"), low)).otherwise(low)


def hex_decode_col(c: Column) -> Column:
    """The number of a signed hexadecimal text; 0 if it is none; the nearest long if it is too large."""
    body = F.regexp_replace(c, "^[+-]", "")
    digits = F.regexp_replace(body, "^0+(?=.)", "")
    minus = c.startswith("-")
    over = (F.length(digits) > 16) | ((F.length(digits) == 16) & (F.substring(digits, 1, 1) > "7"))
    value = F.conv(F.when(over, "0").otherwise(digits), 16, 10).cast("long")
    signed = F.when(over & minus, -MOST - 1).when(over, MOST).when(minus, -value).otherwise(value)
    return F.when(c.isNull(), None).when(c.rlike(r"^[+-]?[0-9a-fA-F]+\z"), signed).otherwise(F.lit(0).cast("long"))


def hex_decode(text: str) -> int:
    """As hex_decode_col, on the driver."""
    if not re.fullmatch(r"[+-]?[0-9a-fA-F]+", text):
        return 0
    return max(-MOST - 1, min(MOST, int(text, 16)))


def hex_decode_all(c: Column, ignore_zero: bool) -> Column:
    out = F.transform(c, hex_decode_col)
    return F.filter(out, lambda x: x != 0) if ignore_zero else out


def ip_encode(c: Column) -> Column:
    """A dotted address as a number; null unless it has four numbers of at most 255."""
    parts = F.transform(F.split(c, "[.]"), lambda p: F.when(p.rlike(r"^[0-9]{1,9}\z"), p.cast("long")))
    valid = (F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull() & (p <= 255))
    return F.when(F.coalesce(valid, F.lit(False)), F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))


def ip_decode(n: Column) -> Column:
    """The dotted address of a number's low 32 bits."""
    return F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8)], n.bitwiseAND(F.lit(255)).cast("string"))


def bytes_be(n: Column, width: int = 8) -> Column:
    """Big-endian bytes of an integer."""
    h = F.hex(n.cast("long"))
    return F.unhex(F.right(F.lpad(h, 16, "0"), F.lit(2 * width)))


def int_be(b: Column) -> Column:
    """The signed 64-bit number of eight big-endian bytes; null for other lengths."""
    h = F.hex(b)
    high, low = (F.conv(F.substring(h, p, 8), 16, 10).cast("long") for p in (1, 9))
    value = F.shiftleft(high, 32).bitwiseOR(low)
    return F.when(F.length(b) == 8, value)


def _swapped(h: Column, width: int) -> Column:
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))])


def bytes_le(n: Column) -> Column:
    """Little-endian bytes of a long."""
    return F.unhex(_swapped(F.lpad(F.hex(n.cast("long")), 16, "0"), 8))


def int_le(b: Column) -> Column:
    """The signed number of eight little-endian bytes; null for other lengths."""
    return F.when(F.length(b) == 8, int_be(F.unhex(_swapped(F.hex(b), 8))))


def uint_be(b: Column) -> Column:
    """The unsigned number of up to eight big-endian bytes, as decimal(20,0)."""
    return F.conv(F.hex(b), 16, 10).cast("decimal(20,0)")


def int32_be(b: Column) -> Column:
    """The signed 32-bit number of four big-endian bytes; null for other lengths."""
    n = F.conv(F.hex(b), 16, 10).cast("long")
    return F.when(F.length(b) == 4, F.when(n >= 2**31, n - 2**32).otherwise(n).cast("int"))


def hash_int(b: Column) -> Column:
    """The low 64 bits of big-endian bytes as a signed number."""
    h = F.lpad(F.right(F.hex(b), F.lit(16)), 16, "0")
    return int_be(F.unhex(h))


def base64_url(b: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(b), "+/\r\n", "-_"), F.lit("="))


def unbase64_url(s: Column) -> Column:
    return unbase64_raw(F.translate(s, "-_", "+/"))


def base64_raw(b: Column) -> Column:
    """Base64 without padding."""
    return F.rtrim(F.translate(F.base64(b), "\r\n", ""), F.lit("="))


def unbase64_raw(s: Column) -> Column:
    """Accepts any padding."""
    bare = F.rtrim(s, F.lit("="))
    return F.unbase64(F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("=")))
