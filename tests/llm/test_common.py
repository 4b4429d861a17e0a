import pyarrow as pa
from pyspark.sql import functions as F

from tidewright.llm.common import small_batches

NAMES = [f"spark.sql.{n}" for n in ("execution.arrow.maxRecordsPerBatch", "execution.arrow.maxBytesPerBatch", "parquet.columnarReaderBatchSize")]


def _sizes(df):
    """Rows and bytes of the batches that a Python worker gets, texts of up to 100,000 bytes."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.column(0).nbytes])], ["rows", "size"])

    return df.mapInArrow(run, "rows long, size long").collect()


def test_long_texts_reach_python_a_megabyte_at_a_time(spark):
    before = {n: spark.conf.get(n, None) for n in NAMES}
    try:
        for n in NAMES:
            spark.conf.unset(n)
        small_batches(spark)
        texts = spark.range(0, 120, 1, 1).select(F.repeat(F.lit("x"), F.when(F.col("id") % 2 == 0, 100_000).otherwise(10).cast("int")).alias("text"))
        got = _sizes(texts)
        assert sum(r["rows"] for r in got) == 120  # every row, once
        assert sum(r["size"] for r in got) >= 60 * 100_000
        assert max(r["size"] for r in got) <= (1 << 20) + 200_000  # a row may go over
        assert int(spark.conf.get(NAMES[2])) <= 512
        short = _sizes(spark.range(0, 2500, 1, 1).select(F.col("id").cast("string").alias("text")))
        assert [r["rows"] for r in short] == [1000, 1000, 500]
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_numbers_of_the_session_stay(spark):
    before = {n: spark.conf.get(n, None) for n in NAMES}
    try:
        for n, v in zip(NAMES, ("70", "5m", "300")):
            spark.conf.set(n, v)
        small_batches(spark)
        assert [spark.conf.get(n) for n in NAMES] == ["70", "5m", "300"]
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
