"""Execution records: counts by statement and slow statements."""

from __future__ import annotations

import threading
from collections import Counter, deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOW_SECONDS = 1.0


@dataclass(frozen=True)
class Record:
    kind: str
    sql: str
    seconds: float


class Monitors:
    """Named listeners; a second one of a name is an error."""

    def __init__(self):
        self.listeners: dict[str, Callable[[Record], None]] = {}

    def add(self, name: str, listener: Callable[[Record], None]) -> None:
        if name in self.listeners:
            raise ValueError(f"a monitor is named {name} already")
        self.listeners[name] = listener

    def tell(self, record: Record) -> None:
        for f in self.listeners.values():
            f(record)


class CountMonitor:
    """Counts by statement; the last records, as many as its room."""

    def __init__(self, room: int = 5000):
        self.counts: Counter[str] = Counter()
        self.recent: deque[Record] = deque(maxlen=room)
        self.lock = threading.Lock()

    def __call__(self, record: Record) -> None:
        with self.lock:
            self.counts[record.sql] += 1
            self.recent.append(record)


def statement_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("sql").agg(F.count("*").alias("n"))


def slow_statements(log: DataFrame, seconds: float = SLOW_SECONDS, delay: str = "delay") -> DataFrame:
    return log.filter(F.col(delay) > seconds)
