"""Helpers of the corpus operators."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import common
from larkspur.sources.files import shared_folder


def test_slices_are_bounded_by_rows_and_bytes():
    texts = ["a" * n for n in (1, 5, 100, 3, 3, 3, 3, 50, 0)] + [None, "b"]
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "t": texts})
    for rows, size in ((3, 10), (100, 10), (1, 10), (4, 1000)):
        parts = list(common.slices(batch, rows, size))
        assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(len(texts)))
        for p in parts:
            assert p.num_rows <= rows and (p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= size)
    assert list(common.slices(batch.slice(0, 0), 3)) == [] and [p.num_rows for p in common.slices(batch.slice(2, 3), 9, 10)] == [1, 2]


def test_scratch_tables(spark):
    df = common.materialize(spark.range(5), "test")
    path = df.scratch.removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path) and path.startswith(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    common.forget(df)
    assert not os.path.exists(path)


def test_no_local_folder_on_a_cluster():
    class Session:
        def __init__(self, master, folder=None):
            self.conf = {"spark.master": master} | ({"spark.checkpoint.dir": folder} if folder else {})

    class Conf(dict):
        set = dict.__setitem__

    def folder(master, own=None):
        s = Session(master, own)
        s.conf = Conf(s.conf)
        return shared_folder(s)

    for master in ("yarn", "spark://h:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="share"):
            folder(master)
        assert folder(master, "hdfs:///x") == "hdfs:///x"
    assert folder("local[2]").startswith("file://")


def test_join_of_hot_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), "id").unionByName(spark.createDataFrame([(None, 1)], "k long, id long"))
    sized = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", -F.col("k"))
    got = common.join_sized(rows, sized, "k", 3001)
    assert got.count() == 3000 and got.where("v <> -k").count() == 0 and "n" not in got.columns
