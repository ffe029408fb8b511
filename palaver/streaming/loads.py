"""The incremental load as a stream: insert-only merge per micro-batch."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from palaver.operators.merge import rows_to_insert
from palaver.sources.sinks import exists, write_batch

BATCH = T.StructField("batch", T.LongType())


def stream_merge(
    chats: DataFrame,
    to_facts: Callable[[DataFrame], DataFrame],
    table: str,
    checkpoint: str,
    keys: Sequence[str] = ("UserID", "ChatID"),
    order_by: Sequence[str] = ("Date",),
    check: Callable[[DataFrame], object] | None = None,
) -> StreamingQuery:
    """Merge a stream of chats into the fact table at `table`, which must exist.

    Each micro-batch writes its own `batch=` folder, and a batch that is retried replaces its
    folder and leaves its own rows out of the target it compares with. So a retry gives the same
    table, also for rows with null keys, which a merge cannot recognise. `check` sees the facts of
    a micro-batch before they are merged and may raise. How much a batch takes is the reader's
    choice (`maxFilesPerTrigger`, `maxBytesPerTrigger`): `files.stream_table` has both.
    """

    def load(rows: DataFrame, batch: int) -> None:
        facts = to_facts(rows).persist()  # one micro-batch: checked, measured and written from here
        try:
            if check is not None:
                check(facts)
            stored = rows.sparkSession.read.schema(T.StructType([*facts.schema.fields, BATCH])).parquet(table)
            target = stored.where(F.col("batch") != batch).select(*facts.columns)
            write_batch(rows_to_insert(facts, target, list(keys), list(order_by), store=False), table, batch)
        finally:
            facts.unpersist()

    return (
        chats.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


ADAPTIVE = "spark.sql.adaptive.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = "day"


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for a while: a query keeps what it started with, a job what it was planned with."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def first_deliveries(rows: DataFrame, keys: Sequence[str], within: str) -> DataFrame:
    """A stream without the rows whose key came already in the last `within` of arrivals.

    The state holds a key for that long after it first arrived and is then freed, so it grows with
    the rate of arrival, not with the table. Time is that of arrival, not of the chat: no row is
    ever too late, however old the chat. A row with a null in its key is never held to be a copy.
    """
    unkeyed = F.lit(False)
    for key in keys:
        unkeyed = unkeyed | F.col(key).isNull()
    marked = rows.withColumns({"_arrived": F.current_timestamp(), "_alone": F.when(unkeyed, F.uuid())})
    return marked.withWatermark("_arrived", within).dropDuplicatesWithinWatermark([*keys, "_alone"]).drop("_arrived", "_alone")


def day_of(date: Column) -> Column:
    return F.to_date(date)


def stored_days(spark: SparkSession, table: str, schema: T.StructType, days: Sequence[object]) -> DataFrame:
    """The rows of some days of a table laid out by `write_days`; the other days are pruned as partitions."""
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField(DAY, T.DateType()), BATCH])).parquet(table)
    named = [d for d in days if d is not None]
    chosen = F.col(DAY).isin(named) if named else F.lit(False)
    return stored.where(chosen | F.col(DAY).isNull() if None in days else chosen)


def write_days(rows: DataFrame, table: str, batch: int, date: str = "Date") -> None:
    """Write one numbered batch into the folders of its days; a repeated batch replaces its own earlier attempt."""
    (
        rows.withColumns({DAY: day_of(F.col(date)), "batch": F.lit(batch).cast("long")}).hint("rebalance", DAY)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY, "batch").parquet(table)
    )


def stream_merge_by_day(
    chats: DataFrame,
    to_facts: Callable[[DataFrame], DataFrame],
    table: str,
    checkpoint: str,
    chat_keys: Sequence[str] = ("UserID", "ID"),
    keys: Sequence[str] = ("UserID", "ChatID"),
    date: str = "Date",
    within: str = "2 days",
    check: Callable[[DataFrame], object] | None = None,
) -> StreamingQuery:
    """Merge a stream of chats into a fact table laid out by day, meeting only what a batch may repeat.

    Copies that arrive within `within` of each other are dropped by keyed state, held in RocksDB,
    before they are shaped and scored. What passes meets the table's rows of the same days: a
    chat's date belongs to the chat, so an earlier delivery lies there. The other days are neither
    read nor listed by key. The cost of a batch follows its rows and the days they fall on, not the
    table. A row that comes again after `within` under another date counts as another chat. A
    retried batch replaces its own folders. The table may start empty, without a folder.

    Spark turns adaptive execution off in a stream with state, for its shuffles must not change.
    The merge of a batch is a job of its own and gets the session's choice back: without it the
    rebalancing by day is left out, and every task writes a file to every day.
    """
    spark = chats.sparkSession

    def load(rows: DataFrame, batch: int) -> None:
        with _setting(rows.sparkSession, ADAPTIVE, spark.conf.get(ADAPTIVE)):
            merge(rows, batch)

    def merge(rows: DataFrame, batch: int) -> None:
        facts = to_facts(rows).persist()  # one micro-batch: checked, measured and written from here
        try:
            if check is not None:
                check(facts)
            days = [row[0] for row in facts.select(day_of(F.col(date))).distinct().collect()]  # the days of one batch
            if not days:
                return
            if exists(rows.sparkSession, table):
                stored = stored_days(rows.sparkSession, table, facts.schema, days)
                target = stored.where(F.col("batch") != batch).select(*facts.columns)
            else:
                target = facts.limit(0)
            write_days(rows_to_insert(facts, target, list(keys), [date], store=False), table, batch, date)
        finally:
            facts.unpersist()

    with _setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB):
        return (
            first_deliveries(chats, chat_keys, within).writeStream.foreachBatch(load)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def compact_batches(spark: SparkSession, table: str, into: str, schema: T.StructType) -> None:
    """All rows of a table of batches as one batch folder of a new table, under the newest batch's number.

    The stream goes on in the new table once it is pointed there; until then the old one is whole.
    """
    stored = spark.read.schema(T.StructType([*schema.fields, BATCH])).parquet(table)
    newest = stored.agg(F.max("batch")).first()[0]
    write_batch(stored.drop("batch").hint("rebalance"), into, newest)
