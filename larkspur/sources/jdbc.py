"""Relational sources over JDBC. Drivers are the cluster's; options are assembled here."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

# Floors of the connection settings.
MIN_OPEN, MIN_IDLE, MIN_LIFETIME_S = 15, 5, 60


@dataclass(frozen=True)
class DbConfig:
    host: str = "127.0.0.1"
    port: int = 0
    database: str = ""
    user: str = ""
    password: str = ""
    kind: str = "postgresql"  # postgresql, mysql or sqlite
    path: str = ""
    max_open: int = 0
    max_idle: int = 0
    lifetime_s: int = 0
    params: dict = field(default_factory=dict)

    @property
    def pool(self) -> tuple[int, int, int]:
        """Open and idle connections and their lifetime, each at its floor at least."""
        return max(self.max_open, MIN_OPEN), max(self.max_idle, MIN_IDLE), max(self.lifetime_s, MIN_LIFETIME_S)


def url(config: DbConfig) -> str:
    tail = "&".join(f"{k}={v}" for k, v in sorted(config.params.items()))
    if config.kind in ("", "postgresql", "postgres", "pgsql"):
        return f"jdbc:postgresql://{config.host}:{config.port or 5432}/{config.database}" + (f"?{tail}" if tail else "")
    if config.kind == "mysql":
        return f"jdbc:mysql://{config.host}:{config.port or 3306}/{config.database}" + (f"?{tail}" if tail else "")
    if config.kind == "sqlite":
        return f"jdbc:sqlite:{config.path}"
    raise ValueError(f"unknown database kind {config.kind!r}")


def options(config: DbConfig, table: str | None = None, query: str | None = None, partition_column: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int | None = None, fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options; with a partition column the ranges are read in parallel, at most as many as the pool is large."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    out = {"url": url(config), "user": config.user, "password": config.password, "fetchsize": str(fetch_size), "pushDownPredicate": "true", "pushDownAggregate": "true", "pushDownLimit": "true"}
    out |= {"dbtable": table} if table is not None else {"query": query}
    if partition_column:
        if table is None or lower is None or upper is None:
            raise ValueError("a partitioned read needs a table and bounds")
        out |= {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(min(partitions or config.pool[0], config.pool[0]))}
    return out


def reader(spark: SparkSession, config: DbConfig, **how) -> DataFrameReader:
    return spark.read.format("jdbc").options(**options(config, **how))


def read(spark: SparkSession, config: DbConfig, **how) -> DataFrame:
    return reader(spark, config, **how).load()


def write(df: DataFrame, config: DbConfig, table: str, mode: str = "append", batch: int = 10_000) -> None:
    df.write.format("jdbc").options(url=url(config), user=config.user, password=config.password, dbtable=table, batchsize=str(batch)).mode(mode).save()
