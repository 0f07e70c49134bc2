"""SQLite tables as a Python data source, read in ranges of rowid; the file must be on a path that all executors see."""

from __future__ import annotations

import sqlite3

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

KINDS = {"INTEGER": T.LongType(), "INT": T.LongType(), "BIGINT": T.LongType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "BLOB": T.BinaryType(), "BOOLEAN": T.BooleanType()}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """Options: path, table, partitions (8)."""

    @classmethod
    def name(cls) -> str:
        return "larkspur_sqlite"

    def schema(self) -> T.StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            rows = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        return T.StructType([T.StructField(r[1], KINDS.get(r[2].split("(")[0].upper(), T.StringType())) for r in rows])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


COMPARISONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.table, self.n = options["path"], options["table"], int(options.get("partitions", "8"))
        self.fields = [(f.name, f.dataType) for f in schema.fields]
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters):
        """Comparisons of whole columns with numbers and texts are the database's; the others stay Spark's."""
        plain = {n for n, k in self.fields if isinstance(k, (T.LongType, T.DoubleType, T.StringType))}
        for f in filters:
            attribute = getattr(f, "attribute", ())
            name = attribute[0] if len(attribute) == 1 else None
            if name in plain and type(f) in COMPARISONS and type(f.value) in (int, float, str):
                self.where.append((f"{_quoted(name)} {COMPARISONS[type(f)]} ?", [f.value]))
            elif name in plain and type(f) is In and f.value and all(type(v) in (int, float, str) for v in f.value):
                self.where.append((f"{_quoted(name)} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif name in plain and type(f) in (IsNull, IsNotNull):
                self.where.append((f"{_quoted(name)} IS {'NOT ' if type(f) is IsNotNull else ''}NULL", []))
            else:
                yield f

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [RowRange(0, 0)]
        step = -(-(high + 1 - low) // self.n)
        return [RowRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part: RowRange):
        names = ", ".join(_quoted(n) for n, _ in self.fields)
        booleans = [isinstance(k, T.BooleanType) for _, k in self.fields]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            more = "".join(f" AND {text}" for text, _ in self.where)
            args = [part.low, part.high, *(a for _, values in self.where for a in values)]
            for row in db.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?{more}", args):
                yield tuple(None if v is None else bool(v) if b else v for v, b in zip(row, booleans, strict=True))


def read(spark: SparkSession, path: str, table: str, partitions: int = 8):
    """Filters that the database can apply reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format(SqliteSource.name()).options(path=path, table=table, partitions=partitions).load()


def execute(path: str, text: str, args=()) -> tuple[int, int]:
    """Runs one statement on the driver: the last id that was given, and how many rows changed."""
    with sqlite3.connect(path) as db:
        done = db.execute(text, list(args))
        return done.lastrowid or 0, max(done.rowcount, 0)
