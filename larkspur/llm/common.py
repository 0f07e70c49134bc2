"""Helpers shared by the corpus operators: table access, Arrow batches, shared scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts its lineage.

    The files outlive any executor, so a later stage never has to recompute what is above. They go when
    the driver ends, or before with `forget`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/larkspur-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete written tables of `materialize` that no frame in use reads any more."""
    for df in tables:
        fs, p = _path(df.sparkSession, df.scratch)
        fs.delete(p, True)


#: Text and binary bytes of one slice; a row of more is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, rows: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most `rows` rows and, beyond one row, `size` bytes of text and binary columns."""
    weight = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_binary(column.type) or pa.types.is_string(column.type) or pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type):
            weight += pc.fill_null(pc.binary_length(column).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(weight), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        end = min(max(end, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def map_batches(df: DataFrame, columns: list, factory: Callable, schema: str, rows: int = 256, size: int = SLICE_BYTES) -> DataFrame:
    """Run factory()(record batch) over slices of at most `rows` rows and `size` bytes of text.

    A slice and one text bound a worker's memory; the factory runs once a task.
    """

    def run(batches):
        fn = factory()
        for batch in batches:
            for part in slices(batch, rows, size):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.select(*columns).mapInArrow(run, schema)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns of these names in any case; new columns of those names take their place."""
    taken = {x.lower() for x in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def join_sized(rows: DataFrame, sized: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """Inner join on key, where sized has each key once and column `n` how many of the `total` rows have it.

    A key with more than a two-thousandth of the rows is hot: there are fewer than two thousand of
    these, which are broadcast, so that their rows stay where they are. The rest is an ordinary join.
    """
    limit = max(total / 2000, 100)
    hot, rest = (sized.where(c).drop(n) for c in (F.col(n) > limit, F.col(n) <= limit))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))
