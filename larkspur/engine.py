"""The engine: one session's tables, queries, raw SQL, monitors and typed settings."""

from __future__ import annotations

import struct
import time
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from .operators import dml, select
from .operators.convert import project_to_schema
from .operators.monitor import CountMonitor, Monitors, Record
from .plans import params as url_params
from .plans.ir import Join, Page, Query, Update


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.monitors = Monitors()
        self.counts = CountMonitor()
        self.monitors.add("count", self.counts)

    def register(self, **tables: DataFrame) -> Engine:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return self

    def sql(self, text: str, args: Sequence | Mapping | None = None) -> DataFrame:
        """Raw SQL with `?` or named parameters; lazy."""
        began = time.perf_counter()
        out = self.spark.sql(text, args=list(args) if isinstance(args, (list, tuple)) else args)
        self.monitors.tell(Record("query", text, time.perf_counter() - began))
        return out

    def rows(self, text: str, args: Sequence | None = None, schema: T.StructType | None = None) -> DataFrame:
        """As `sql`, with columns mapped to a schema by name."""
        df = self.sql(text, args)
        return df if schema is None else project_to_schema(df, schema)

    def one(self, text: str, args: Sequence | None = None, schema: T.StructType | None = None) -> tuple[bool, Row | None]:
        """(found, first row)."""
        found = self.rows(text, args, schema).limit(1).collect()
        return (True, found[0]) if found else (False, None)

    def query(self, table: str, columns: str, query: Query, max_page_size: int = 100, join: Join | None = None) -> select.Result:
        return select.build_query(self.spark, table, columns, query, max_page_size, join)

    def query_url(self, url: str, fields: Mapping[str, url_params.FieldDefined], table: str, columns: str, max_page_size: int = 100, join: Join | None = None, **how) -> select.Result:
        return self.query(table, columns, url_params.parse_query(url_params.params_of(url), fields, **how), max_page_size, join)

    def append_limit(self, text: str, args: Sequence, page: Page, max_page_size: int) -> DataFrame:
        return select.append_limit(self.sql(text, args), page, max_page_size)

    def update(self, df: DataFrame, update: Update, allowed: Sequence[str], pk: str = "id") -> tuple[DataFrame, int]:
        """The new snapshot and the number of rows changed."""
        return dml.apply_update(df, update, allowed, pk), dml.affected(df, update, allowed, pk)


def setting(spark: SparkSession, name: str, kind: type, default):
    """A typed session setting; the default where it is missing or can't be read."""
    text = spark.conf.get(name, None)
    if text is None:
        return default
    try:
        return text.strip().lower() in ("true", "1") if kind is bool else kind(text)
    except ValueError:
        return default


class Context:
    """Typed values of one request. A getter gives the type's zero where the key is missing or holds another type."""

    RANGES = {"int": (-(2**63), 2**63 - 1), "int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1), "uint": (0, 2**64 - 1), "uint32": (0, 2**32 - 1), "uint64": (0, 2**64 - 1)}

    def __init__(self, values: Mapping[str, object]):
        self.values = dict(values)

    def whole(self, key: str, kind: str = "int") -> int | None:
        """A number that fits the kind, else None."""
        v, (low, high) = self.values.get(key), self.RANGES[kind]
        return v if type(v) is int and low <= v <= high else None

    def int(self, key: str) -> int:
        return self.whole(key) or 0

    def uint(self, key: str) -> int:
        return self.whole(key, "uint") or 0

    def int32(self, key: str) -> int:
        return self.whole(key, "int32") or 0

    def uint32(self, key: str) -> int:
        return self.whole(key, "uint32") or 0

    def int64(self, key: str) -> int:
        return self.whole(key, "int64") or 0

    def uint64(self, key: str) -> int:
        return self.whole(key, "uint64") or 0

    def float64(self, key: str) -> float:
        v = self.values.get(key)
        return v if type(v) is float else 0.0

    def float32(self, key: str) -> float:
        """To the nearest single-precision number."""
        return struct.unpack("f", struct.pack("f", self.float64(key)))[0]

    def string(self, key: str) -> str:
        v = self.values.get(key)
        return v if type(v) is str else ""

    def time(self, key: str) -> datetime:
        """1970 where there is none."""
        v = self.values.get(key)
        return v if isinstance(v, datetime) else datetime.fromtimestamp(0, timezone.utc)

    def bool(self, key: str) -> bool:
        return self.values.get(key) is True
