"""Sinks: stage runs, serving table, partition replacement, batch-keyed appends, CSV exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.functions.times import run_stamp
from palaver.operators.merge import replaced_partition_split
from palaver.operators.quality import observed_metrics
from palaver.session import fresh_path, shared_dir
from palaver.sources.files import CSV_OPTIONS


def new_run(spark: SparkSession) -> str:
    """A run name from the session's clock, with a part that tells runs of one moment apart."""
    now = F.current_timestamp()
    stamp, micros = spark.range(1).select(run_stamp(now), F.date_format(now, "SSSSSS")).first()
    return f"{stamp}_{micros}_{uuid.uuid4().hex[:8]}"


def write_stage(df: DataFrame, stage: str, run: str | None = None) -> str:
    """Write a stage table as a new run and return the run's name.

    Also the way to rewrite a table that the frame itself reads: the old run stays untouched
    until the new one is complete, and readers take the newest complete one.
    """
    run = run or new_run(df.sparkSession)
    df.write.mode("errorifexists").parquet(f"{stage}/run={run}")
    return run


def write_observed_stage(df: DataFrame, stage: str, means: Sequence[str] = (), run: str | None = None) -> tuple[str, dict]:
    """Write a stage run and return its name and the frame's `observed_metrics`, gathered while it was written.

    The metrics belong to the last stage of the job, the one that writes: Spark counts each of its
    tasks once, however often it was tried.
    """
    watch = Observation()
    name = write_stage(df.observe(watch, *observed_metrics(df, means)), stage, run)
    return name, watch.get


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder the library wrote for itself."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_serving(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def create_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Create an empty table, or empty an existing one."""
    spark.createDataFrame([], schema).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """One append, committed when the whole job is: no batch of it is visible before."""
    df.write.mode("append").parquet(path)


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """Write one numbered batch; a repeated batch replaces its own earlier attempt."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def replace_newest_partition(rows: DataFrame, path: str, date_column: str = "CurrentDate", run: str | None = None) -> None:
    """Load rows into a table partitioned by `TransactionDateID`.

    The partition of the newest date among the rows is replaced, rows of other dates are added. On
    this load path a blank text is the null marker, so blanks are stored as null.

    Both happen in one job that overwrites the dates concerned: what older dates hold already is
    put beside the rows in a stored copy first. `run` names the load. A load that broke off and is
    tried again under its name finds its copy and writes that once more, so the table is as after
    one load, wherever it broke off. The rows themselves are evaluated once, into a copy of their
    own; the newest date and both parts are read from there.
    """
    spark = rows.sparkSession
    stage = f"{shared_dir(spark)}/replace-{run}" if run else fresh_path(spark, "replace")
    if not exists(spark, f"{stage}/_SUCCESS"):
        arrived = fresh_path(spark, "arrived")
        rows.write.parquet(arrived)
        rows = spark.read.schema(rows.schema).parquet(arrived)
        newest = rows.agg(F.max(date_column)).first()[0]
        if newest is None:
            return
        replacing, adding = replaced_partition_split(rows, newest, date_column)
        table = adding.unionByName(replacing)
        if exists(spark, path):
            stored = spark.read.schema(table.schema).parquet(path)
            # The dates of late rows: at most as many as the table has folders.
            older = [row[0] for row in adding.select("TransactionDateID").distinct().collect()]
            table = table.unionByName(stored.where(_among("TransactionDateID", older)).select(*table.columns))
        table.write.mode("overwrite").parquet(stage)
    (
        spark.read.parquet(stage).hint("rebalance", "TransactionDateID")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("TransactionDateID")
        .parquet(path)
    )


def _among(column: str, values: Sequence[object]) -> Column:
    """Whether a column holds one of the values; a null among them stands for a null."""
    named = [v for v in values if v is not None]
    chosen = F.col(column).isin(named) if named else F.lit(False)
    return chosen | F.col(column).isNull() if None in values else chosen


def rewrite_partitions(
    spark: SparkSession, path: str, schema: T.StructType, by: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]
) -> list:
    """Rewrite the partitions of a stored table that `touched` names (its one column), and return which.

    `change` maps the rows of those partitions to what they become. They are put into a stored copy,
    and that overwrites them, so a write that breaks off can be repeated from there; the other
    partitions' files are not opened.
    """
    values = [row[0] for row in touched.distinct().collect()]  # at most as many as the table has folders
    if not values:
        return []
    copy = fresh_path(spark, "rewrite")
    change(spark.read.schema(schema).parquet(path).where(_among(by, values))).write.parquet(copy)
    (
        spark.read.schema(schema).parquet(copy).hint("rebalance", by)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    )
    return values


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_bucketed(df: DataFrame, table: str, buckets: int, *keys: str, mode: str = "overwrite") -> None:
    """Store a table bucketed by its merge keys: the merge then reads it without a shuffle.

    The rows are shuffled into the buckets first, so a load adds one file per bucket, not one per
    task and bucket.
    """
    (
        df.repartition(buckets, *keys)
        .write.mode(mode)
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .format("parquet")
        .saveAsTable(table)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_OPTIONS, timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
