"""Random addresses of a province from a table of ranges (province, min, max as addresses)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ids import ip_decode, ip_encode


def flatten(ranges: DataFrame) -> DataFrame:
    """From (province, ranges array<struct<min,max>>) to (province, low, high) with numbers."""
    flat = ranges.select("province", F.explode("ranges").alias("r"))
    return flat.select("province", ip_encode(F.col("r.min")).alias("low"), ip_encode(F.col("r.max")).alias("high"))


def random_ips(asked: DataFrame, ranges: DataFrame, seed: int | None = None, province: Column | None = None) -> DataFrame:
    """All columns of asked and ip: a range of the row's province is drawn evenly, then an address of it (min included, max not).

    Without `province`, all ranges together are drawn from. A province without ranges gives null. The
    ranges of a province are an array joined on its name, small beside the rows asked for.
    """
    usable = ranges.where("low is not null and high > low")
    cell = F.struct("low", "high")
    rows = asked.withColumn("__p", province if province is not None else F.lit("")).withColumn("__a", F.rand(seed)).withColumn("__b", F.rand(None if seed is None else seed + 1))
    key = F.col("province") if province is not None else F.lit("")
    lists = usable.groupBy(key.alias("__p")).agg(F.sort_array(F.collect_list(cell)).alias("__r"))
    joined = rows.join(lists, "__p", "left")
    pick = F.get("__r", F.floor(F.col("__a") * F.size("__r")).cast("int"))
    ip = ip_decode((F.floor(F.col("__b") * (pick["high"] - pick["low"])) + pick["low"]).cast("long"))
    return joined.withColumn("ip", F.when(F.col("__r").isNotNull(), ip)).drop("__p", "__a", "__b", "__r")
