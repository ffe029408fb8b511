"""Re-run-safe loads on tables without MERGE: insert-only merge, backfills, partition replacement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.schemas import FACT_TABLE, SENTIMENTS
from palaver.session import fresh_path


def _all(columns: Sequence[Column]) -> Column:
    return reduce(Column.__and__, columns)


def _have_keys(df: DataFrame, keys: Sequence[str]) -> Column:
    return _all([F.col(k).isNotNull() for k in keys])


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the first in the given order (a row hash breaks ties).

    An aggregate, not a ranking window: copies of a key fall away on the map side, so a key with
    very many copies sends one row per task.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    order = F.struct(*order_by, F.xxhash64(*keys, *rest))
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return kept.select(*keys, "_row.*").select(*[F.col(f"`{c}`") for c in df.columns])


def rows_to_insert(
    source: DataFrame, target: DataFrame, keys: Sequence[str], order_by: Sequence[str], store: bool = True
) -> DataFrame:
    """Source rows that an insert-only merge adds to the target.

    A key already in the target is skipped, a key repeated in the source goes in once. A row with
    a null in its key matches nothing: it is always added, and takes no part in any shuffle.

    Loaded rows go first, by an anti join with the target's bare keys, so only what is new is
    reduced to one row per key; the reduction keeps the join's partitioning. A semi join of the
    target with the batch's keys thins it out before: no hint, so AQE broadcasts the keys of a
    small batch from their measured size, and a target bucketed by its keys is not shuffled.

    The source's keys, keyed rows and other rows take different ways. It is stored in the shared
    folder first, so whatever made it runs once, and all three are of one run; `store=False` is for
    a source that lies stored already.
    """
    if store:
        path = fresh_path(source.sparkSession, "merge-source")
        source.write.parquet(path)
        source = source.sparkSession.read.schema(source.schema).parquet(path)
    keyed, unkeyed = source.where(_have_keys(source, keys)), source.where(~_have_keys(source, keys))
    known = target.select(*keys).where(_have_keys(target, keys))
    known = known.join(keyed.select(*keys).distinct(), list(keys), "left_semi")
    new = keyed.join(known, list(keys), "left_anti").select(*source.columns)
    return first_per_key(new, keys, order_by).unionByName(unkeyed)


def insert_only_merge(
    source: DataFrame, target: DataFrame, keys: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """The target as it is after the merge."""
    return target.unionByName(rows_to_insert(source, target, keys, order_by))


def new_nearest(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows to insert into the nearest-player table: at most one per (player, rank), the nearest."""
    named = source.select(
        F.col("UserID_newplayers").alias("UserID"),
        F.col("UserID_vip").alias("UserID_VIP"),
        F.col("distance").alias("Distance"),
        "Country",
        "RN",
    )
    return rows_to_insert(named, target, ["UserID", "RN"], ["Distance", "UserID_VIP"])


def merge_nearest(source: DataFrame, target: DataFrame) -> DataFrame:
    return target.unionByName(new_nearest(source, target))


def backfill_nulls(
    target: DataFrame, source: DataFrame, keys: Sequence[str], column: str, order_by: str
) -> DataFrame:
    """Fill nulls of a column from the first non-null source value of the same key.

    One left join: the target is read once, AQE splits the partition of a key with very many rows.
    A row with a null in its key meets nothing and stays as it is.
    """
    usable = source.where(_have_keys(source, keys) & F.col(column).isNotNull())
    first = usable.groupBy(*keys).agg(F.min_by(column, order_by).alias("_fill"))
    filled = target.join(first, list(keys), "left")
    return filled.withColumn(column, F.coalesce(F.col(column), F.col("_fill"))).select(*target.columns)


def backfill_key(
    target: DataFrame, source: DataFrame, keys: Sequence[str], column: str, order_by: str
) -> DataFrame:
    """Overwrite a column with the source's value wherever the source has a row with the same keys."""
    usable = source.where(_have_keys(source, keys))
    first = usable.groupBy(*keys).agg(F.min_by(F.struct(F.col(column)), order_by).alias("_row"))
    joined = target.join(first, list(keys), "left")
    value = F.when(F.col("_row").isNotNull(), F.col(f"_row.{column}")).otherwise(F.col(column))
    return joined.withColumn(column, value).select(*target.columns)


def replaced_partition_split(
    rows: DataFrame, newest: object, date_column: str = "CurrentDate"
) -> tuple[DataFrame, DataFrame]:
    """Rows of the newest date and the others, in stored form: blank texts null, date column renamed."""
    texts = {name for name, kind in rows.dtypes if kind == "string"}
    stored = rows.select(
        *[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) if c in texts else F.col(f"`{c}`") for c in rows.columns]
    ).withColumnRenamed(date_column, "TransactionDateID")
    is_newest = F.coalesce(F.col("TransactionDateID") == F.lit(newest), F.lit(False))
    return stored.where(is_newest), stored.where(~is_newest)


def to_fact_table(df: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """Serving rows in the warehouse's column types, with the load time. Scores round to two places."""
    moment = F.current_timestamp().cast("timestamp_ntz") if loaded_at is None else loaded_at
    named = df.withColumnsRenamed({c: f"{c}_Score" for c in ("Negative", "Neutral", "Positive")})
    named = named.withColumn("TransactionDate", moment)
    return named.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FACT_TABLE.fields])


def _described(values: DataFrame, project: str, kind: str, comment: str) -> DataFrame:
    """The audit row of a one-row frame with Stat1 to Stat3 and RecordCount."""
    described = [
        column
        for n, label in enumerate(SENTIMENTS, start=1)
        for column in (F.col(f"Stat{n}"), F.lit(f"mean {label} score").alias(f"Stat{n}Desc"))
    ]
    return values.select(
        F.lit(project).alias("Project"),
        F.lit(kind).alias("TrainOrPredict"),
        *described,
        "RecordCount",
        F.lit(comment).alias("Comments"),
    )


def audit_row(scored: DataFrame, project: str, kind: str, comment: str = "") -> DataFrame:
    """One run-audit row: mean class scores of a scored frame and its row count."""
    means = [F.round(F.avg(label), 6).alias(f"Stat{n}") for n, label in enumerate(SENTIMENTS, start=1)]
    return _described(scored.agg(*means, F.count("*").alias("RecordCount")), project, kind, comment)


def observed_audit_row(spark: SparkSession, observed: dict, project: str, kind: str, comment: str = "") -> DataFrame:
    """The same row from the metrics that the write of the scored frame observed."""
    means = [F.round(F.lit(observed[f"mean {label}"]).cast("double"), 6).alias(f"Stat{n}") for n, label in enumerate(SENTIMENTS, start=1)]
    return _described(spark.range(1).select(*means, F.lit(observed["rows"]).cast("long").alias("RecordCount")), project, kind, comment)
