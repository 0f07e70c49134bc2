"""Search, masking and validation of strings, and set algebra of arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 18-digit citizen number.
WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
CHECKS = ("1", "0", "x", "9", "8", "7", "6", "5", "4", "3", "2")
# Fixed patterns.
MOBILE = r"^1[3456789][0-9]{9}\z"
EMAIL = r"^[a-zA-Z0-9_-]+@[a-zA-Z0-9_-]+(\.[a-zA-Z0-9_-]+)+\z"
USERNAME = r"^[a-zA-Z0-9._@-]{6,32}\z"
PASSWORD = r"^[.*\[A-Za-z]\][.*\d\[$@!%#?&]\][A-Za-z\d$@!%*#?&]{6,20}\z"


def byte_search(s: Column, p: Column) -> Column:
    """0-based byte offset of p in s, -1 if there is none; an empty s has nothing, an empty p is at 0."""
    at = F.position(p, s)
    found = F.octet_length(F.substring(s, F.lit(1), at - 1))
    return F.when(F.length(s) == 0, -1).when(F.length(p) == 0, 0).when(at == 0, -1).otherwise(found)


def mask_mobile(m: Column) -> Column:
    """Characters 4 to 7 become stars; shorter than 7 stays."""
    return F.when(F.char_length(m) >= 7, F.overlay(m, F.lit("****"), 4, 4)).otherwise(m)


def verify_mobile(c: Column) -> Column:
    return c.rlike(MOBILE)


def verify_email(c: Column) -> Column:
    return c.rlike(EMAIL)


def verify_username(c: Column) -> Column:
    return c.rlike(USERNAME)


def verify_password(c: Column) -> Column:
    return c.rlike(PASSWORD)


def verify_id_card(c: Column) -> Column:
    """18 bytes whose last is the check sign of the weighted sum of the others; what is no digit counts 0."""
    digits = [F.coalesce(F.when(F.substring(c, i + 1, 1).rlike(r"^[0-9]\z"), F.substring(c, i + 1, 1).cast("int")), F.lit(0)) for i in range(17)]
    total = digits[0] * WEIGHTS[0]
    for d, w in zip(digits[1:], WEIGHTS[1:], strict=True):
        total = total + d * w
    check = F.element_at(F.array(*[F.lit(x) for x in CHECKS]), (total % 11 + 1).cast("int"))
    return (F.octet_length(c) == 18) & (F.substring(c, 18, 1) == check)


def distinct(a: Column) -> Column:
    return F.array_distinct(a)


def difference(source: Column, target: Column) -> Column:
    """struct(source_only, target_only), with duplicates and order kept."""
    only = lambda a, b: F.filter(a, lambda x: ~F.array_contains(b, x))
    return F.struct(only(source, target).alias("source_only"), only(target, source).alias("target_only"))


def read_ids(a: Column) -> Column:
    """Decimal texts as longs; 0 and what is none are left out, too large ones become the nearest long."""

    def one(x: Column) -> Column:
        n = F.when(x.rlike(r"^[+-]?[0-9]+\z"), x)
        return F.coalesce(n.try_cast("long"), F.when(n.startswith("-"), F.lit(-(2**63))).when(n.isNotNull(), F.lit(2**63 - 1)))

    return F.filter(F.transform(a, one), lambda x: x.isNotNull() & (x != 0))
