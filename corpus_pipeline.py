"""A training corpus from ``documents``: drop poor texts, keep one of each group of near copies, mix sources, cut into pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. Between stages rows are written as Parquet under
``spark.checkpoint.dir`` and read again, so a lost executor costs no more than a task of its stage. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import jaccard_join, mixing, nbest, ordinal
from tidewright.session import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents which the ordinal classifier, fitted on ``labels``, takes for good (grade 2) with a probability of 0.5 or more.

    Texts without words go. Without usable labels all others stay. Rows stay as they are, repeats and null ids included.
    """
    grades = ordinal.quality_grades(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(ordinal.accepted(spark, ordinal.fit(docs, grades)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 5-word shingles at a likeness of 0.8.

    Rows are told apart by id and text: an id on unlike texts loses none that has no copy left, and a null id comes after all others.
    Repeats of the row that stays count once. Rows without words have no copies; they stay, repeats under one id (not null) once.
    """
    found = settle(jaccard_join.jaccard_components(docs.withColumn("__mark", F.xxhash64("text")), mark="__mark").select("doc_id", "mark", "first"))
    kept = found.where("first").agg(F.count("*").alias("n"), F.count_distinct(F.struct("doc_id", "mark")).alias("pairs")).first()
    gone = settle(found.where("not first").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__gone")).distinct())
    small = gone.count() <= jaccard_join.SMALL_TABLE  # 16 MB of ids and hashes; beyond that the join shuffles
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__gone"))
    out = docs.join(F.broadcast(gone) if small else gone, same, "left_anti")
    if kept["n"] > kept["pairs"]:
        unnamed = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        out = out.where(~unnamed).dropDuplicates(["doc_id", "text"]).unionByName(out.where(unnamed))
    return out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weights 3, 1, 2, ...: 150% of all words, twice a source's own at most. A document taken twice is two rows."""
    rows = docs.withColumn("__mix_words", mixing.word_count("text"))
    return mixing.repeat_rows(mixing.mix(rows, size="__mix_words")).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id source n_tokens`` with the best segmentation of the text and the three next ones as changes to it."""
    out = nbest.encode_nbest(docs, ["doc_id", "source"])
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("mixing sources", mixture), ("SentencePiece n-best", pieces)]
#: A fitted model and a vocabulary decide here, which SQL can't state; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
