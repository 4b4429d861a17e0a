"""Registry of queries: a Spark function and, where SQL can say the same, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.columns import finite_or_null

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Lazy readers of the supplied tables: ``t.orders`` reads ``orders.parquet``. NaN and infinities are missing values, so NULL."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return rows.withColumns({c: finite_or_null(F.col(c)) for c, kind in rows.dtypes if kind in ("float", "double")})


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register
