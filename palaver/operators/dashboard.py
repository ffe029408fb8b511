"""Dashboard aggregates over fact rows. All of them combine on the map side: only counts move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.times import round_hour
from palaver.schemas import ALL_AGENTS, ALL_BRANDS, ALL_COUNTRIES, SENTIMENTS

OPTION_FIELDS = {"Brand": ALL_BRANDS, "CountryGroup1": ALL_COUNTRIES, "AgentDisplayName": ALL_AGENTS}


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Chats per key combination, in key order. Rows with a null key are left out."""
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df.groupBy(*keys).agg(F.count("*").alias("chats")).orderBy(*keys)


def per_hour(df: DataFrame, *dimensions: str) -> DataFrame:
    """Chats per rounded hour and, if given, per further dimension."""
    # Nulls are sorted out before rounding, or each row would be rounded for the filter as well.
    hourly = df.where(F.col("Date").isNotNull()).select(round_hour(F.col("Date")).alias("Date"), *dimensions)
    for dimension in dimensions:
        hourly = hourly.where(F.col(dimension).isNotNull())
    return hourly.groupBy("Date", *dimensions).agg(F.count("*").alias("chats")).orderBy("Date", *dimensions)


def vip_by_sentiment(df: DataFrame) -> DataFrame:
    return count_by(df, "VIPLevel", "Sentiment")


def vip_pivot(df: DataFrame) -> DataFrame:
    """VIP level against sentiment; combinations without chats are 0."""
    table = df.where(F.col("VIPLevel").isNotNull()).groupBy("VIPLevel").pivot("Sentiment", list(SENTIMENTS))
    return table.agg(F.count(F.lit(1))).na.fill(0, list(SENTIMENTS)).orderBy("VIPLevel")


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("Sentiment").agg(F.count("*").alias("chats")).orderBy(F.desc("chats"), "Sentiment")


def bounds(df: DataFrame) -> DataFrame:
    """Slider bounds: first date, last date plus a day, VIP and duration cut to whole numbers."""
    return df.agg(
        F.min("Date").alias("date_min"),
        (F.max("Date") + F.expr("INTERVAL '1' DAY")).alias("date_max"),
        F.min("VIPLevel").cast("int").alias("viplevel_min"),
        F.max("VIPLevel").cast("int").alias("viplevel_max"),
        F.min("DurationInMins").cast("int").alias("durationinmin_min"),
        F.max("DurationInMins").cast("int").alias("durationinmin_max"),
    )


def options(df: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """Pick-list entries as (field, place, value): place 0 the "all" entry, 1 the values found.

    Rows rather than one array per field, so a field with very many values stays distributed.
    """
    fields = OPTION_FIELDS if fields is None else fields
    found = df.select(*fields).unpivot([], list(fields), "field", "value").where(F.col("value").isNotNull())
    entries = found.distinct().select("field", F.lit(1).alias("place"), "value")
    everything = F.explode(F.array(*[F.struct(F.lit(f), F.lit(0), F.lit(v)) for f, v in fields.items()]))
    spark = df.sparkSession
    sentinels = spark.range(1).select(everything.alias("e")).select("e.*").toDF("field", "place", "value")
    return sentinels.union(entries).orderBy("field", "place", "value")


def chat_types(df: DataFrame) -> DataFrame:
    """Chat types in the order in which they first occur."""
    first = df.groupBy("ChatType").agg(F.min(F.struct("Date", "ChatID")).alias("first"))
    return first.select(
        "ChatType", F.col("first.Date").alias("first_date"), F.col("first.ChatID").alias("first_chat")
    ).orderBy("first_date", "first_chat")


def totals(df: DataFrame, filtered: DataFrame) -> DataFrame:
    """Rows in the table and rows left by a filter."""
    everything = df.agg(F.count("*").alias("table_rows")).select("table_rows").scalar()
    return filtered.agg(F.count("*").alias("hits")).select(everything.alias("table_rows"), "hits")


def hourly_charts(df: DataFrame) -> DataFrame:
    """(chart, Date, value, chats): per hour, per hour and sentiment, per hour and country, in one pass.

    The rows are counted once per (hour, sentiment, country); the three charts roll that up.
    """
    counted = (
        df.where(F.col("Date").isNotNull())
        .select(round_hour(F.col("Date")).alias("Date"), "Sentiment", "CountryGroup1")
        .groupBy("Date", "Sentiment", "CountryGroup1").agg(F.count("*").alias("chats"))
    )
    views = F.explode(F.array(
        F.struct(F.lit("per_hour").alias("chart"), F.lit(None).cast("string").alias("value")),
        F.struct(F.lit("hour_sentiment").alias("chart"), F.col("Sentiment").alias("value")),
        F.struct(F.lit("hour_country").alias("chart"), F.col("CountryGroup1").alias("value")),
    ))
    rows = counted.select("Date", "chats", views.alias("v")).select("v.chart", "Date", "v.value", "chats")
    kept = rows.where((F.col("chart") == "per_hour") | F.col("value").isNotNull())
    return kept.groupBy("chart", "Date", "value").agg(F.sum("chats").alias("chats"))


def dashboard(df: DataFrame, density_points: int = 500) -> dict[str, DataFrame]:
    """Every chart of the dashboard over one filtered frame.

    The three hourly charts are `hourly`, one frame from one pass; `vip_<sentiment>` are the series
    of `vip_sentiment`.
    """
    from palaver.operators.density import density

    vip = vip_by_sentiment(df)
    return {
        "hourly": hourly_charts(df),
        "vip_sentiment": vip,
        **{f"vip_{label.lower()}": vip.where(F.col("Sentiment") == label) for label in SENTIMENTS},
        "density": density(df, points=density_points),
    }
