"""Search results, single-chat details, display names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.numbers import half_even
from palaver.functions.scores import very_positive
from palaver.functions.text import preview
from palaver.operators.filters import ChatFilter, chat_by_id
from palaver.operators.ordering import first_rows, random_support_chat
from palaver.schemas import DISPLAY_NAMES

NOT_IN_RESULTS = ("html_text", "Rating", "Negative", "Neutral", "Positive")


def display_names(df: DataFrame) -> DataFrame:
    """Rename analytic columns to their display names; other columns stay."""
    return df.withColumnsRenamed({c: DISPLAY_NAMES[c] for c in df.columns if c in DISPLAY_NAMES})


def rename_by_position(df: DataFrame, *names: str) -> DataFrame:
    """The columns under other names, in their order; as many names as columns."""
    return df.toDF(*names)


def search_results(df: DataFrame, chosen: ChatFilter, n: int = 500) -> DataFrame:
    """The first n hits as the results table shows them: no scores, whole minutes, text preview."""
    hits = first_rows(chosen.apply(df), n)
    shown = hits.withColumns(
        {"DurationInMins": half_even(F.col("DurationInMins")), "text": preview(F.col("text"))}
    )
    return display_names(shown.drop(*NOT_IN_RESULTS))


def hit_count(df: DataFrame, chosen: ChatFilter) -> DataFrame:
    return chosen.apply(df).agg(F.count("*").alias("hits"))


def export_hits(df: DataFrame, chosen: ChatFilter, n: int = 100) -> DataFrame:
    return first_rows(chosen.apply(df), n).drop("html_text")


def as_field_rows(df: DataFrame) -> DataFrame:
    """(ChatID, field, value): every record turned into rows of display name and text value."""
    shown = display_names(df.drop("html_text", "text").withColumn("_key", F.col("ChatID")))
    fields = [c for c in shown.columns if c != "_key"]
    texts = shown.select("_key", *[F.col(f"`{c}`").cast("string").alias(c) for c in fields])
    return texts.unpivot(["_key"], [F.col(f"`{c}`") for c in fields], "field", "value").withColumnRenamed(
        "_key", "ChatID"
    )


def chat_details(df: DataFrame, chat_id: str | None = None, seed: str = "") -> DataFrame:
    """One chat; without an id, one support chat picked by the seed."""
    if chat_id:
        return chat_by_id(df, chat_id)
    return df.join(random_support_chat(df, seed), "ChatID", "left_semi")  # one row on the right


def with_very_positive(df: DataFrame, at_least: float = 0.8) -> DataFrame:
    return df.withColumn("very_positive", very_positive(F.col("Sentiment"), F.col("Positive"), at_least))
