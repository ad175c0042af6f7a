"""A query and, where SQL can express it, its DuckDB oracle, registered under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Tables of long texts, on which narrow stages work hardest.
TEXTS = {"documents", "conversations"}
#: A table in fewer partitions than this and than there are cores is dealt anew; larger ones never are.
FEW = 32


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is a small table that one or a few tasks would read alone."""
    cores = min(FEW, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """The tables of one folder by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        found = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(found) if name in TEXTS else found

    def rows(self, data: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(data, schema)


def query(name: str, sql: str | None = None):
    """Registers a function of Tables as a query."""

    def wrap(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def rounded(name: str, places: int = 6) -> Column:
    """A number as the oracles round it: the scaled double is rounded, where F.round rounds its shortest decimal and so goes up at halves just below."""
    return F.round(F.col(name) * 10.0**places) / 10.0**places


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    """A VALUES list of strings and numbers."""
    return "VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
