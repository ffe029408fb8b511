"""A serving table with a trigram index over one text column: searches read the blocks that may hold a hit.

The table lies in folders, each a run of blocks of chats that follow each other in time. The index
is a table of (trigram, block) ordered by trigram. A search asks it which blocks hold the trigrams
that its expression must have. Folders without such a block are pruned as partitions, before a
file is opened; inside a folder the block numbers are sorted and a page of the file holds one
block, so the bounds in the file leave out the others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.operators.filters import ChatFilter
from palaver.operators.patterns import LOWER, UPPER, Need, holds, required, trigrams_of
from palaver.schemas import FACT

BLOCK_ROWS = 10_000
FOLDER_BLOCKS = 64  # blocks of a folder
PIECE = 1 << 16  # characters of a text whose trigrams are listed at once
MOST_RANGES = 1_000  # runs of neighbouring blocks a search names in its filter; of more, it joins with the blocks
FOLDER, BLOCK = "folder", "block"


def trigrams(rows: DataFrame, column: str) -> DataFrame:
    """(block, trigram): the distinct runs of three characters of a block's texts, A to Z as small letters.

    Long texts are taken in pieces that overlap by two characters.
    """
    text = F.translate(F.col(column), UPPER, LOWER)
    starts = F.sequence(F.lit(0), F.floor((F.char_length(column) - 1) / PIECE).cast("int"))
    pieces = F.transform(starts, lambda k: text.substr(k * PIECE + 1, F.lit(PIECE + 2)))
    listed = rows.where(F.char_length(column) > 2).select(BLOCK, F.explode(pieces).alias("piece"))
    # A look-ahead matches at every character and takes none, so the runs overlap.
    found = F.array_distinct(F.regexp_extract_all("piece", F.lit("(?s)(?=(.{3}))"), F.lit(1)))
    return listed.select(BLOCK, F.explode(found).alias("trigram")).distinct()


def _stored_folders(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the table's folders, from their names."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/rows/{FOLDER}=*")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(int(status.getPath().getName().removeprefix(f"{FOLDER}=")) for status in found or [])


def append_indexed(
    facts: DataFrame, path: str, column: str = "html_text", block_rows: int = BLOCK_ROWS, order: Sequence[str] = ("Date", "ChatID")
) -> None:
    """Add rows to the table at `path` in new folders, then to its index.

    The rows of one load are ranged and sorted by `order` and cut into blocks of `block_rows`; they
    are read several times for that and should lie stored. What an earlier load wrote stays
    untouched. A load that breaks off between the table and the index leaves folders without an
    index: searches read those in any case, so no hit is missed.
    """
    spark = facts.sparkSession
    first = max(_stored_folders(spark, path), default=-1) + 1
    folders = max(1, -(-facts.count() // (block_rows * FOLDER_BLOCKS)))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of a row in its task
    number = F.least(F.floor(place / block_rows), F.lit(FOLDER_BLOCKS - 1))  # ranges are not quite equal: the last block takes the rest
    (
        facts.repartitionByRange(folders, *order).withColumn(FOLDER, F.spark_partition_id() + first)
        .sortWithinPartitions(FOLDER, *order).withColumn(BLOCK, F.col(FOLDER).cast("long") * FOLDER_BLOCKS + number)
        .write.mode("append").option("parquet.page.row.count.limit", block_rows).partitionBy(FOLDER).parquet(f"{path}/rows")
    )
    new = read_indexed(spark, path, facts.schema).where(F.col(FOLDER) >= first)
    (
        trigrams(new, column).repartitionByRange("trigram", BLOCK).sortWithinPartitions("trigram", BLOCK)
        .write.mode("append").parquet(f"{path}/trigrams")
    )
    new.groupBy(FOLDER, BLOCK).agg(F.count("*").alias("rows")).write.mode("append").parquet(f"{path}/indexed")


def read_indexed(spark: SparkSession, path: str, schema: T.StructType = FACT) -> DataFrame:
    """The whole table, with its block and folder numbers."""
    more = [T.StructField(BLOCK, T.LongType()), T.StructField(FOLDER, T.IntegerType())]
    return spark.read.schema(T.StructType([*schema.fields, *more])).parquet(f"{path}/rows")


def indexed_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(folder, block, rows): what a finished load has indexed."""
    return spark.read.schema(f"{FOLDER} int, {BLOCK} long, rows long").parquet(f"{path}/indexed")


def blocks_with(spark: SparkSession, path: str, need: Need) -> DataFrame:
    """(block): the indexed blocks that meet a requirement."""
    indexed = indexed_blocks(spark, path).select(BLOCK).distinct()
    if need is None:
        return indexed
    postings = spark.read.schema(f"{BLOCK} long, trigram string").parquet(f"{path}/trigrams")
    # Only the asked-for trigrams are read, and a block has at most as many entries.
    there = postings.where(F.col("trigram").isin(trigrams_of(need))).groupBy(BLOCK).agg(F.collect_set("trigram").alias("there"))
    return there.where(holds(need, F.col("there"))).select(BLOCK).join(indexed, BLOCK, "left_semi")


def _ranges(blocks: DataFrame) -> DataFrame:
    """(folder, low, high): the runs of neighbouring blocks, each within its folder."""
    numbered = blocks.withColumn(FOLDER, F.expr(f"CAST({BLOCK} div {FOLDER_BLOCKS} AS INT)"))
    place = F.row_number().over(Window.partitionBy(FOLDER).orderBy(BLOCK))
    return numbered.withColumn("run", F.col(BLOCK) - place).groupBy(FOLDER, "run").agg(F.min(BLOCK).alias("low"), F.max(BLOCK).alias("high"))


def candidates(spark: SparkSession, path: str, chosen: ChatFilter, column: str = "html_text", schema: T.StructType = FACT) -> DataFrame:
    """The rows of all blocks that may hold a hit of the filter's search, without their block numbers.

    All blocks, if the search is for another column or its expression names nothing that must
    occur. Folders that no finished load has indexed are always among them.
    """
    rows = read_indexed(spark, path, schema)
    need = required(chosen.search) if chosen.search and chosen.search_column == column else None
    if need is None:
        return rows.drop(BLOCK, FOLDER)
    known = {row[0] for row in indexed_blocks(spark, path).select(FOLDER).distinct().collect()}  # as many as the table has folders
    loose = sorted(set(_stored_folders(spark, path)) - known)
    fitting = blocks_with(spark, path, need)
    ranges = sorted(_ranges(fitting).limit(MOST_RANGES + 1).collect(), key=lambda r: r["low"])
    if len(ranges) <= MOST_RANGES:
        within = [(F.col(BLOCK) >= r["low"]) & (F.col(BLOCK) <= r["high"]) for r in ranges]
        if loose:
            within.append(F.col(FOLDER).isin(loose))
        folders = sorted({r[FOLDER] for r in ranges} | set(loose))
        # The folders are named apart, as a condition on them alone prunes them.
        found = rows.where(F.col(FOLDER).isin(folders)).where(reduce(Column.__or__, within)) if within else rows.where(F.lit(False))
    else:
        found = rows.join(fitting, BLOCK, "left_semi")
        if loose:
            found = found.unionByName(rows.where(F.col(FOLDER).isin(loose)))
    return found.drop(BLOCK, FOLDER)
