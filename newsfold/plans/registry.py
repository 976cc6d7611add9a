"""Registry of queries over the driver tables, and helpers to write them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function ``(tables) -> DataFrame`` under its name, with its SQL if SQL can express it."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


class Tables:
    """The driver tables of a folder, read with column pruning by Spark."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places and counts to 64 bit, as the SQL side gives them."""
    kinds = {"double": lambda c: F.round(F.col(c), 6).alias(c), "int": lambda c: F.col(c).cast("long").alias(c), "smallint": lambda c: F.col(c).cast("long").alias(c)}
    return df.select(*[kinds.get(t, F.col)(c) for c, t in df.dtypes])
