"""Structured Streaming: a durable queue of messages, statement counts, schedules and values that expire."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MIN_MESSAGE, MAX_MESSAGE = 4, 4 << 20
MESSAGE = "message binary, queued_at timestamp"


def put(messages: DataFrame, folder: str) -> None:
    """Appends messages of allowed size to the queue's folder, as one commit; another size is an error."""
    size = F.octet_length("message")
    checked = F.when(size.between(MIN_MESSAGE, MAX_MESSAGE), F.col("message")).otherwise(F.raise_error(F.lit("a message has 4 bytes to 4 MiB")))
    messages.select(checked.alias("message"), F.current_timestamp().alias("queued_at")).write.mode("append").parquet(folder)


def queue(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """The queue as a stream, oldest files first; a checkpoint remembers what has been read."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def consume(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Calls handler(batch, number) at least once for each batch; default: what is there, then stops."""
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def every(stream: DataFrame, seconds: float, handler: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A processing-time schedule."""
    return consume(stream, handler, checkpoint, processingTime=f"{seconds} seconds")


def statement_counts(log: DataFrame) -> DataFrame:
    """Running counts by statement of a stream with a column sql."""
    return log.groupBy("sql").agg(F.count("*").alias("n"))


def count_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch's counts by statement in a folder of its own, so that a repeated batch counts once."""

    def handle(batch: DataFrame, number: int) -> None:
        statement_counts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def batch_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sql string, n long, batch long").parquet(path).groupBy("sql").agg(F.sum("n").alias("n"))


def _last_value(ttl_ms: int):
    def run(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[1] if state.exists else 0
        value = None
        for part in rows:
            n += len(part)
            value = part["value"].iloc[-1]
        state.update((value, n))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"key": [key[0]], "value": [value], "n": [n]})

    return run


def ttl_cache(stream: DataFrame, ttl_ms: int) -> DataFrame:
    """Stateful cache of a stream (key string, value string): a key's newest value and how many it has had, forgotten `ttl_ms` of processing time after the last.

    Expiry needs batches without data, so such a stream runs until it is stopped: give it a processing-time trigger.
    """
    return stream.groupBy("key").applyInPandasWithState(_last_value(ttl_ms), "key string, value string, n long", "value string, n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def live(df: DataFrame, now_nanos: int) -> DataFrame:
    """The batch form: entries (exp in unix nanoseconds) that have not expired."""
    return df.filter(F.col("exp") > F.lit(now_nanos))
