"""The catalogue of runnable queries, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}

# Text tables whose work is per row. In fewer files than there are cores they would keep only
# a few cores busy; a table of many files is left as it lies. The parts grow in number with the
# table, by its splits, so that a part does not grow.
SPREAD = {"documents": "doc_id", "pages": "page_id"}
PARTS_PER_SPLIT = 2


class Tables:
    """The given tables of one scale folder; ``ts`` columns come as UTC instants."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name == "events":
            df = df.withColumn("ts", F.col("ts").cast("timestamp"))
        return self._dealt(df, SPREAD[name]) if name in SPREAD else df

    def spread(self, name: str, key: str, rows: int) -> DataFrame:
        """A table of small rows that each cost much: about ``rows`` a part, as its size on disk
        says little about its work."""
        df = getattr(self, name)
        return self._dealt(df, key, -(-df.count() // rows))

    def _dealt(self, df: DataFrame, key: str, parts: int = 0) -> DataFrame:
        cores = self.spark.sparkContext.defaultParallelism
        if parts == 0 and len(df.inputFiles()) >= cores:
            return df
        return df.repartition(max(cores, parts, PARTS_PER_SPLIT * df.rdd.getNumPartitions()), key)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(lambda spark, folder: fn(Tables(spark, folder)), sql)
        return fn

    return wrap
