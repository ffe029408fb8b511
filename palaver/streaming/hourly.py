"""Hourly counts kept current from a stream of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palaver.functions.times import round_hour
from palaver.sources.sinks import write_batch


def partial_counts(facts: DataFrame, *dimensions: str) -> DataFrame:
    """Chats per rounded hour (and dimensions) of some facts; rows without a date are left out."""
    hourly = facts.where(F.col("Date").isNotNull()).select(round_hour(F.col("Date")).alias("Date"), *dimensions)
    return hourly.groupBy("Date", *dimensions).agg(F.count("*").alias("chats"))


def start_hourly_counts(facts: DataFrame, table: str, checkpoint: str, *dimensions: str) -> StreamingQuery:
    """Write the counts of every micro-batch of a stream of facts; a retried batch replaces its folder.

    Nothing is kept between batches, so a row may come as late as it likes and is counted once.
    How much a batch takes is the reader's choice (`maxFilesPerTrigger`, `maxBytesPerTrigger`).
    """
    return (
        facts.writeStream.foreachBatch(
            lambda rows, batch: write_batch(partial_counts(rows, *dimensions), table, batch)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_hourly_counts(spark: SparkSession, table: str, *dimensions: str) -> DataFrame:
    """The count of every hour: the sum of what the batches counted."""
    return spark.read.parquet(table).groupBy("Date", *dimensions).agg(F.sum("chats").alias("chats"))


def compact_hourly_counts(spark: SparkSession, table: str, into: str, *dimensions: str) -> None:
    """The same counts as one batch folder of a new table, under the newest batch's number.

    The stream goes on in the new table once it is pointed there; until then the old one is whole.
    """
    newest = spark.read.parquet(table).agg(F.max("batch")).first()[0]
    write_batch(read_hourly_counts(spark, table, *dimensions), into, newest)
