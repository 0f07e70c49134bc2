"""Columnar and text files of any path that Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_all_text(spark: SparkSession, path: str) -> str:
    """A whole small file; an empty text if it can't be read."""
    if not exists(spark, path):
        return ""
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def ip_ranges(spark: SparkSession, path: str) -> DataFrame:
    """A JSON lines table of ranges: province, ranges array<struct<min,max>>."""
    return spark.read.schema("province string, ranges array<struct<min:string,max:string>>").json(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of this machine in local mode, an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.conf.get("spark.master", "") or ""
    if not master.startswith("local") or "cluster" in master:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/larkspur-{tag}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table, read back: its columns are the scan's, so filters on them reach it."""
    path = fresh_path(df.sparkSession, tag) + "/data"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
