"""The corpus pipeline: documents in, packed sequences out.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
frame that is written and read again before the next one. All but the last return the columns of
documents. Null keys, null texts and extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import decontaminate, language, packing, secrets, simhash
from palaver.llm.common import remainder, settled

BATCH_BYTES = "8m"  # of the Arrow batches that whole documents travel in; Spark's default of 64 MB is held several times over


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents but those without letters and those long enough to tell that they are of no learned language.

    Prototypes are learned from the labelled documents of the same folds as the registered query.
    Rows with one key and text share their prediction, so copies stay copies.
    """
    _small_batches(spark)
    langs, prototypes = language.prototypes(docs.filter(remainder("doc_id", language.FOLDS) != language.HELD_OUT))
    return language.keep_known(docs, langs, prototypes)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest key."""
    _small_batches(spark)
    return simhash.one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; `n_chars` follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    _small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = settled(docs, f"pipeline-{number}")
    return docs
