"""Session helpers: a local session for tests and benches, and lineage cutting for jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tidewright", cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benches; clusters bring their own configuration."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the session names, or a scratch one in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="tidewright-ckpt-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(named)
    return named


def settle(df: DataFrame, **options) -> DataFrame:
    """Cut lineage with a table written under the shared checkpoint folder.

    Later branches read the same stored rows, with column pruning and real size statistics, and a lost
    executor costs a re-read instead of a recomputation. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
