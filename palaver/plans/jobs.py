"""The jobs: extract and shape, score and load, serve."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.functions.text import mask_pii
from palaver.operators.dashboard import dashboard
from palaver.operators.extract import chats_with_profile, max_loaded, not_yet_loaded, started_within
from palaver.operators.filters import ChatFilter
from palaver.operators.merge import backfill_nulls, observed_audit_row, rows_to_insert
from palaver.operators.quality import impute, repeated_keys, require_no_nulls, require_none_observed
from palaver.operators.scoring import score_by_lexicon
from palaver.operators.transcripts import shape_chats
from palaver.schemas import FACT, SENTIMENTS
from palaver.session import fresh_path
from palaver.sources.sinks import append, remove, rewrite_partitions, write_bucketed, write_observed_stage

MERGE_KEYS = ["UserID", "ChatID"]


def windowed_chats(
    chats: DataFrame,
    as_of: Column | str | None = None,
    days: int | None = 10,
    loaded: DataFrame | None = None,
    first_load_days: int = 30,
    mode: str = "timestamp",
) -> DataFrame:
    """Recent chats, or with `loaded` those not loaded yet.

    `days` is the rolling window, None takes all. With `loaded` it does not count: chats later than
    anything loaded are taken, or, while nothing is, those of the last `first_load_days` days.
    """
    if loaded is not None:
        return not_yet_loaded(chats, loaded, as_of, first_load_days, mode)
    return chats if days is None else started_within(chats, as_of, days)


def fixed_window(spark: SparkSession, window: dict[str, object]) -> dict[str, object]:
    """The same window with its two moving bounds, now and the newest loaded chat, read once.

    Whatever asks for the window's chats during a run then gets the same ones, also after the run
    has added to the table of loaded chats.
    """
    fixed = dict(window)
    if fixed.get("as_of") is None:
        fixed["as_of"] = F.lit(spark.range(1).select(F.current_timestamp().cast("timestamp_ntz")).first()[0])
    if fixed.get("loaded") is not None:
        newest = max_loaded(fixed["loaded"]).first().max_date
        fixed["loaded"] = spark.createDataFrame([(newest,)], "Date timestamp_ntz")
    return fixed


def shaped_chats(
    chats: DataFrame,
    profile: DataFrame,
    phrases: DataFrame,
    dialect: str = "auto",
    where: Column | None = None,
    unreadable: str | None = None,
    **window: object,
) -> DataFrame:
    """Chats ready for scoring: those of the window, with attributes and texts.

    The window is applied before the join, and the shaping after it is one narrow stage.
    `html_text` is masked here, message by message; `text` is masked after scoring. `where` picks
    chats by any column but the transcript, before the parse. `unreadable` keeps the chats that
    cannot be read, their transcript in a column of that name.
    """
    joined = chats_with_profile(windowed_chats(chats, **window), profile)
    return shape_chats(joined, phrases, mask=True, dialect=dialect, where=where, unreadable=unreadable)


def scored_facts(shaped: DataFrame, score: Callable[[DataFrame], DataFrame] = score_by_lexicon, *more: str) -> DataFrame:
    """Fact rows: scored on the text as written, imputed, then masked. Nothing unmasked is stored. `more` names columns to keep."""
    scored = impute(score(shaped)).withColumn("text", mask_pii(F.col("text"))).withColumnRenamed("ID", "ChatID")
    return scored.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FACT.fields], *more)


def load_facts(facts: DataFrame, path: str, target: DataFrame | None, observed: dict | None = None) -> None:
    """Gate on nulls, then insert what the target does not have yet.

    `target` is the table at `path` as read before the load, or None for a first load. `facts` lie
    stored. `observed` are the metrics of their write; without them the gate reads the facts.
    """
    if observed is None:
        require_no_nulls(facts)
    else:
        require_none_observed(observed)
    if target is None:
        target = facts.limit(0)
    append(rows_to_insert(facts, target, MERGE_KEYS, ["Date"], store=False), path)


def load_bucketed_facts(facts: DataFrame, table: str, buckets: int, check: bool = True) -> None:
    """The same load into a catalogue table bucketed by the merge keys, which it creates if missing.

    Only the batch is shuffled, whatever the size of the table.
    """
    spark = facts.sparkSession
    exists = spark.catalog.tableExists(table)
    target = spark.table(table) if exists else facts.limit(0)
    new = rows_to_insert(require_no_nulls(facts) if check else facts, target, MERGE_KEYS, ["Date"])
    write_bucketed(new, table, buckets, *MERGE_KEYS, mode="append" if exists else "overwrite")


def backfill_partitions(
    spark: SparkSession, path: str, schema: T.StructType, by: str, source: DataFrame, keys: Sequence[str], column: str, order_by: str
) -> list:
    """Fill the nulls of a column of a table partitioned by `by`, as `backfill_nulls` does, and return the partitions rewritten.

    Rewritten are those with a null that the source can fill; a first pass over the keys and the
    column finds them.
    """
    target = spark.read.schema(schema).parquet(path)
    fillable = source.where(F.col(column).isNotNull()).select(*keys).distinct()
    touched = target.where(F.col(column).isNull()).join(fillable, list(keys), "left_semi").select(by)
    return rewrite_partitions(spark, path, schema, by, touched, lambda rows: backfill_nulls(rows, source, keys, column, order_by))


def facts_of(
    profile: DataFrame, phrases: DataFrame, score: Callable[[DataFrame], DataFrame] = score_by_lexicon
) -> Callable[[DataFrame], DataFrame]:
    """Chats to fact rows, for `stream_merge(chats, facts_of(...), ..., check=require_no_nulls)`."""

    def to_facts(chats: DataFrame) -> DataFrame:
        return scored_facts(shaped_chats(chats, profile, phrases, days=None), score)

    return to_facts


def run_load(
    spark: SparkSession,
    chats: DataFrame,
    profile: DataFrame,
    phrases: DataFrame,
    stage: str,
    fact_path: str,
    audit_path: str,
    quarantine_path: str | None = None,
    first_load: bool = False,
    score: Callable[[DataFrame], DataFrame] = score_by_lexicon,
    **window: object,
) -> str:
    """Extract, shape, score, stage, load, audit. Returns the stage run's name.

    The scored chats are staged once, and the gate and the audit know them from the metrics that
    the write observed: the stage is read again by the merge alone. The window's bounds are read
    once, at the start. Chats of the window with an unreadable transcript are added to the table at
    `quarantine_path`, if one is given, before the load; they hold personal data as written. They
    come out of the same parse as the others: one job writes both side by side into a folder of
    its own, which is taken apart and removed.
    """
    if not repeated_keys(profile, "UserID").isEmpty():
        raise ValueError("profile has users with several rows: they would multiply chats")
    window = fixed_window(spark, window)
    if quarantine_path is None:
        facts = scored_facts(shaped_chats(chats, profile, phrases, **window), score)
        run, observed = write_observed_stage(facts, stage, SENTIMENTS)
    else:
        run, observed = _stage_and_quarantine(spark, shaped_chats(chats, profile, phrases, unreadable="Messages", **window), score, stage, quarantine_path)
    facts = spark.read.schema(FACT).parquet(f"{stage}/run={run}")
    target = None if first_load else spark.read.schema(FACT).parquet(fact_path)
    load_facts(facts, fact_path, target, observed)
    append(observed_audit_row(spark, observed, "chat sentiment", "predict", run), audit_path)
    return run


def _stage_and_quarantine(
    spark: SparkSession, shaped: DataFrame, score: Callable[[DataFrame], DataFrame], stage: str, quarantine_path: str
) -> tuple[str, dict]:
    """Write the facts of readable chats as a stage run and add the unreadable ones to the quarantine, from one pass."""
    raw = {"ID": "string", "UserID": "long", "started": "timestamp_ntz", "Messages": "string"}
    kept = F.struct(F.col("ID"), F.col("UserID"), F.col("Date").alias("started"), F.col("Messages"))
    # The scorer sees a blank where there is nothing to read; its answer for it is dropped.
    marked = shaped.withColumn("_raw", F.when(F.col("Messages").isNotNull(), kept)).withColumn("text", F.coalesce("text", F.lit("")))
    facts = scored_facts(marked, score, "_raw")
    path = fresh_path(spark, "load")
    try:
        facts.withColumn("readable", F.col("_raw").isNull()).write.partitionBy("readable").parquet(path)
        both = spark.read.schema(T.StructType([*facts.schema.fields, T.StructField("readable", T.BooleanType())])).parquet(path)
        run, observed = write_observed_stage(both.where("readable").select(*FACT.names), stage, SENTIMENTS)
        append(both.where("NOT readable").select(*[F.col(f"_raw.{name}").cast(kind).alias(name) for name, kind in raw.items()]), quarantine_path)
    finally:
        remove(spark, path)
    return run, observed


def serve_dashboard(facts: DataFrame, chosen: ChatFilter = ChatFilter()) -> dict[str, DataFrame]:
    """All charts for one choice of filters; each reads only its own columns of the serving table."""
    return dashboard(chosen.apply(facts))
