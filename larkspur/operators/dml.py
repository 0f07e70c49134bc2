"""Row changes as new snapshots: every function returns the frame after the change.

Parquet tables can't be updated in place, so a change is a rewrite; `Snapshots` publishes one by
creating a numbered commit file after all its data are written, so readers see all of it or nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ir import Field, Update, ValueType
from .predicates import QueryError, column, conjunction


def set_value(params: dict, name: str, value, remove_null: bool) -> None:
    """Puts a value unless it is None or, with remove_null, empty (an empty text or bytes, the int 0, the zero time)."""
    if value is None:
        return
    if remove_null and (value in ("", b"") or type(value) is int and value == 0 or isinstance(value, datetime) and value == datetime.min):
        return
    params[name] = value


def check_rows(count: int, expected: int) -> None:
    if count != expected:
        raise QueryError(f"{count} rows changed instead of {expected}")


def update_value(field: Field):
    """A field's new value; None where the field is to be skipped."""
    v = field.value
    if v is None or not field.col:
        return None
    if v.kind is ValueType.STRING:
        return v.data or None
    if v.kind in (ValueType.INT, ValueType.DOUBLE, ValueType.BOOL, ValueType.TIME, ValueType.STATUS):
        return v.resolved()
    return None


def build_update(update: Update, allowed: Iterable[str]) -> dict[str, object]:
    """Accepted columns and their values: whitelisted, and not skipped. The id must not be 0."""
    if not update.id:
        raise QueryError("an update needs an id")
    allowed = set(allowed)
    return {f.col: v for f in update.fields if f.col in allowed and (v := update_value(f)) is not None}


def apply_update(df: DataFrame, update: Update, allowed: Iterable[str], pk: str = "id") -> DataFrame:
    """Rows with the id that meet the conditions get the values; without accepted fields nothing changes."""
    values = build_update(update, allowed)
    if not values:
        return df
    hit = _hit(update, pk)
    return df.withColumns({c: F.when(hit, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def _hit(update: Update, pk: str):
    extra = conjunction(update.conditions)
    hit = column(pk) == F.lit(update.id)
    return hit if extra is None else hit & F.coalesce(extra, F.lit(False))


def affected(df: DataFrame, update: Update, allowed: Iterable[str], pk: str = "id") -> int:
    """How many rows an update changes."""
    return df.filter(_hit(update, pk)).count() if build_update(update, allowed) else 0


def set_columns(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """An update of all rows."""
    return df.withColumns({c: F.lit(v).cast(df.schema[c].dataType) for c, v in values.items()})


def delete_by_id(df: DataFrame, id_: int, pk: str = "id") -> DataFrame:
    """Rows with a null id stay."""
    return df.filter(~column(pk).eqNullSafe(F.lit(id_)))


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True).select(*df.columns)


def upsert(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace those with their keys. One shuffle on the keys; a small change is broadcast by its size."""
    return insert(df.join(rows.select(*keys), keys, "left_anti").select(*df.columns), rows)


def _names(table: str, params: Mapping[str, object]) -> list[str]:
    names = sorted(params)
    for n in (*names, *table.split(".")):
        column(n)
    if not names:
        raise QueryError("a statement needs columns")
    return names


def insert_sql(table: str, params: Mapping[str, object]) -> tuple[str, list]:
    """A parameterised INSERT with sorted columns."""
    names = _names(table, params)
    return f"INSERT INTO {table} ({', '.join(f'`{n}`' for n in names)}) VALUES ({', '.join('?' * len(names))})", [params[n] for n in names]


def update_sql(table: str, params: Mapping[str, object]) -> tuple[str, list]:
    """A parameterised UPDATE of all rows, to which the caller adds conditions."""
    names = _names(table, params)
    return f"UPDATE {table} SET {', '.join(f'`{n}` = ?' for n in names)}", [params[n] for n in names]


def upsert_sql(table: str, params: Mapping[str, object], keys: Iterable[str] = ()) -> tuple[str, list]:
    """An INSERT that updates the row with the same keys; without keys, in the form of stores that know them themselves."""
    text, args = insert_sql(table, params)
    keys = list(keys)
    for k in keys:
        column(k)
    rest = [n for n in sorted(params) if n not in keys]
    if keys:
        change = ", ".join(f"`{n}` = excluded.`{n}`" for n in rest)
        return f"{text} ON CONFLICT ({', '.join(f'`{k}`' for k in keys)}) DO " + (f"UPDATE SET {change}" if rest else "NOTHING"), args
    return f"{text} ON DUPLICATE KEY UPDATE {', '.join(f'`{n}` = ?' for n in rest)}", args + [params[n] for n in rest]


STATEMENTS = {"insert": insert_sql, "update": update_sql, "upsert": upsert_sql}


def statement(kind: str, table: str, params: Mapping[str, object], plain_names: bool = False, **how) -> tuple[str, list]:
    """The text and arguments of a kind of statement; plain_names leaves the quotes of names out, as some stores want it."""
    if kind not in STATEMENTS:
        raise QueryError(f"unknown statement {kind!r}")
    text, args = STATEMENTS[kind](table, params, **how)
    return (text.replace("`", "") if plain_names else text), args


def changed(df: DataFrame, kind: str, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The same statements on a frame: the rows after an insert, an upsert by keys, or an update of rows with the keys."""
    if kind == "insert":
        return insert(df, rows)
    if not keys:
        raise QueryError("an upsert or update needs keys")
    if kind == "upsert":
        return upsert(df, rows, keys)
    if kind != "update":
        raise QueryError(f"unknown statement {kind!r}")
    new = rows.select(*keys, F.struct(*[c for c in rows.columns if c not in keys]).alias("__new"))
    out = df.join(new, keys, "left")
    return out.select(*[F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in rows.columns and c not in keys else F.col(c) for c in df.columns])


class Snapshots:
    """A table as numbered Parquet versions under one path of any Hadoop file system.

    A version is published by the exclusive creation of its commit file, which holds the name of its data
    and a closing line; a reader takes the highest complete one, so there is no moment without a table. A
    writer whose base is no longer the newest version gets an error instead of overwriting it. A commit file
    that a writer left incomplete is passed over by readers and stops writers until `repair`.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.staged: DataFrame | None = None
        self.depth = 0
        self.base: int | None = None

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> dict[int, str | None]:
        """Number -> name of the data; None where the file is incomplete."""
        jvm, root, fs = self._fs()
        if not fs.exists(root):
            return {}
        out: dict[int, str | None] = {}
        for status in fs.listStatus(root):
            p = status.getPath()
            if p.getName().startswith("COMMIT-"):
                with_size = min(status.getLen(), 1000)
                stream = fs.open(p)
                try:
                    text = bytes(stream.readNBytes(with_size)).decode()
                finally:
                    stream.close()
                out[int(p.getName()[7:])] = text[:-4] if text.endswith("\nok\n") else None
        return out

    def number(self) -> int:
        """Of the newest complete version; 0 before the first."""
        return max((n for n, v in self._commits().items() if v), default=0)

    def read(self) -> DataFrame:
        """The staged state inside a transaction, else the newest version."""
        if self.staged is not None:
            return self.staged
        done = {n: v for n, v in self._commits().items() if v}
        if not done:
            raise QueryError("nothing has been written yet")
        n = max(done)
        if self.depth and self.base is None:
            self.base = n
        return self.spark.read.parquet(f"{self.path}/{done[n]}")

    def write(self, df: DataFrame, base: int | None = None) -> None:
        """Publishes df as the version after `base` (the newest one where that is not given)."""
        if self.depth:
            if self.base is None:
                self.base = self.number()
            self.staged = df
        else:
            self._publish(df, self.number() if base is None else base)

    def _publish(self, df: DataFrame, base: int) -> None:
        name = f"v{base + 1:012d}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.path}/{name}")
        jvm, _, fs = self._fs()
        if max(self._commits(), default=0) > base:
            self._drop(name)
            raise QueryError(f"version {base} of {self.path} is no longer the newest; read it again")
        try:
            out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/COMMIT-{base + 1:012d}"), False)
        except Exception as e:
            self._drop(name)
            raise QueryError(f"version {base + 1} of {self.path} has been written by another") from e
        out.write(bytearray(f"{name}\nok\n".encode()))
        out.close()

    def _drop(self, name: str) -> None:
        jvm, _, fs = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def repair(self) -> int:
        """Removes incomplete commit files, of writers that are known to be dead; how many."""
        left = [n for n, v in self._commits().items() if v is None]
        for n in left:
            self._drop(f"COMMIT-{n:012d}")
        return len(left)

    @contextmanager
    def transaction(self):
        """Writes inside are published together at the end, or not at all after an error. A nested one joins the outer.

        The base is the version that was first read or newest at the first write; if another writer has published since, it is an error.
        """
        self.depth += 1
        try:
            yield self
            if self.depth == 1 and self.staged is not None:
                self._publish(self.staged, self.base or 0)
        finally:
            self.depth -= 1
            if not self.depth:
                self.staged, self.base = None, None
