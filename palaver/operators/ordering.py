"""Operators defined by row order: first rows, one random row, global index, batches, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.operators.filters import support_chats
from palaver.session import checkpointed

ROWS_PER_RANGE = 1_000_000


def first_rows(df: DataFrame, n: int = 500) -> DataFrame:
    """The first n chats by time: a top-n per task, then a merge of those."""
    return df.orderBy("Date", "ChatID").limit(n)


def random_support_chat(df: DataFrame, seed: str = "") -> DataFrame:
    """One support chat picked by a seeded hash of its id: repeatable, and an aggregate, not a sort."""
    picked = support_chats(df).agg(
        F.min_by("ChatID", F.struct(F.md5(F.concat(F.col("ChatID"), F.lit(seed))), "ChatID")).alias("ChatID")
    )
    return picked.where(F.col("ChatID").isNotNull())


def with_global_index(df: DataFrame, order_by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Add `row_index`, 0 for the first row in the given (total) order, without a global sort task.

    Rows are split into ranges of the order, numbered within each range, and shifted by the rows
    in the ranges before. The ranges are pinned by a checkpoint: they come from a sample, and
    counts and rows must see the same ones. There are as many as the row count calls for, and no
    fewer than the session's shuffle partitions.
    """
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = partitions or max(spread, 1 + df.count() // ROWS_PER_RANGE)
    ranged = checkpointed(df.repartitionByRange(n, *order_by).withColumn("_range", F.spark_partition_id()))
    # One row per range on this side: at most `n`.
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order_by))
    return (
        ranged.withColumn("_place", inside)
        .join(F.broadcast(offsets), "_range")
        .withColumn("row_index", F.col("_offset") + F.col("_place") - 1)
        .drop("_range", "_place", "_offset")
    )


def fixed_batches(df: DataFrame, size: int, order_by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Add `batch`: rows in order, `size` to a batch, the last one may be short."""
    indexed = with_global_index(df, order_by, partitions)
    return indexed.withColumn("batch", F.floor(F.col("row_index") / size)).drop("row_index")


def near_equal_parts(df: DataFrame, parts: int, order_by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Add `part`: rows in order, in parts whose sizes differ by one at most, larger ones first."""
    indexed = with_global_index(df, order_by, partitions)
    total = indexed.agg(F.count("*")).scalar()
    small = F.floor(total / parts)
    larger = total - small * parts
    edge = larger * (small + 1)  # rows held by the larger parts
    i = F.col("row_index")
    place = F.when(i < edge, F.floor(i / (small + 1))).otherwise(
        larger + F.floor((i - edge) / F.greatest(small, F.lit(1)))
    )
    return indexed.withColumn("part", place).drop("row_index")
