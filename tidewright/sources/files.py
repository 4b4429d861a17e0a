"""File sources and sinks with explicit schemas."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str, timestamp_format: str | None = None) -> DataFrame:
    """CSV with a header and a stated schema: no inference pass over the files."""
    reader = spark.read.schema(schema).option("header", True)
    if timestamp_format:
        reader = reader.option("timestampNTZFormat", timestamp_format).option("timestampFormat", timestamp_format)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Parquet, partitioned for pruning; rows of one partition value go to the same files."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = df.repartition(*partition_by, F.spark_partition_id() % 16).write.mode("overwrite").partitionBy(
            *partition_by)
    writer.parquet(path)
    return path


def tidy_header(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Column names without outer spaces, in lower case, then renamed."""
    names = {c: c.strip().lower() for c in df.columns}
    out = df.withColumnsRenamed({a: b for a, b in names.items() if a != b})
    return out.withColumnsRenamed(renames) if renames else out
