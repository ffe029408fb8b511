"""Chat-shaped views over the sample star schema (events, customers, conversations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators.extract import chats_with_profile
from palaver.operators.quality import impute
from palaver.operators.transcripts import ordered_concat
from palaver.schemas import AGENT_COLUMN

# Declared, so that opening a table costs no footer-reading job.
TABLES = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "conversations": "conv_id long, turn long, role string, text string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as profiles. Only accounts in credit have one, so the outer join leaves nulls."""
    customer, nation, region = (table(spark, sf_dir, name) for name in ("customer", "nation", "region"))
    return (
        customer.where(F.col("c_acctbal") > 0)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("UserID"),
            F.floor(F.col("c_acctbal") / 2000).cast("int").alias("VIPlevelNo"),
            F.col("c_mktsegment").alias("BrandFriendlyName"),
            F.col("r_name").alias("CountryGroup1"),
        )
    )


def chats_of(events: DataFrame) -> DataFrame:
    """Events as chats (no transcript). The number in `props` stands for the visitor's mood."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").cast("string").alias("ID"),
        F.col("user_id").alias("UserID"),
        F.lit(None).cast("string").alias("Messages"),
        F.when(kind == "purchase", "rated_good")
        .when(kind == "error", "rated_bad")
        .otherwise("not_rated")
        .alias("rate"),
        F.round(F.col("value") * 60).cast("long").alias("duration"),
        F.col("ts").alias("started"),
        F.when(kind == "error", "ChatBot,auto").when(kind != "signup", "support").alias("tags"),
        F.lit(None).cast("int").alias("AgentMessagesCount"),
        F.lit(None).cast("int").alias("VisitorMessagesCount"),
        F.concat(F.lit("Agent "), F.floor(F.hour("ts") / 4).cast("string")).alias(AGENT_COLUMN),
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("mood"),
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats_of(table(spark, sf_dir, "events"))


def fact_of(chat_rows: DataFrame, profile_rows: DataFrame) -> DataFrame:
    """Dashboard fact rows; the sentiment is a stand-in, by mood thirds."""
    joined = impute(chats_with_profile(chat_rows, profile_rows, keep=("mood",)))
    return joined.select(
        F.col("ID").alias("ChatID"),
        "UserID",
        "Date",
        "VIPLevel",
        "Rating",
        "DurationInMins",
        "Brand",
        "CountryGroup1",
        "ChatType",
        "AgentDisplayName",
        _sentiment(),
    )


def _sentiment() -> Column:
    mood = F.col("mood")
    return F.when(mood <= 33, "Negative").when(mood <= 66, "Neutral").otherwise("Positive").alias("Sentiment")


def moods(chat_rows: DataFrame) -> DataFrame:
    """Time and stand-in sentiment of chats, without their profiles."""
    return chat_rows.where(F.col("ID").isNotNull()).select(F.col("started").alias("Date"), _sentiment())


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_of(chats(spark, sf_dir), profile(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, one per row."""
    role, conv = F.col("role"), F.col("conv_id").cast("string")
    return table(spark, sf_dir, "conversations").select(
        conv.alias("Key"),
        F.col("turn").alias("pos"),
        F.concat(role, conv).alias("author_name"),
        F.when(role == "user", "visitor").when(role == "assistant", "agent").otherwise("supervisor").alias("user_type"),
        F.concat(F.lit("2024-01-01 00:"), F.lpad(F.col("turn").cast("string"), 2, "0")).alias("date"),
        "text",
    )


def _joined_transcripts(messages: DataFrame) -> DataFrame:
    joined = ordered_concat(messages, ["Key"], "pos", "message", separator=",")
    return joined.select(
        F.col("Key").alias("ID"), F.concat(F.lit("["), F.col("message"), F.lit("]")).alias("Messages")
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ID, Messages): each conversation as one JSON transcript."""
    message = F.to_json(F.struct("author_name", "user_type", "date", "text"))
    return _joined_transcripts(turns(spark, sf_dir).select("Key", "pos", message.alias("message")))


def literal_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as Python literals that are not JSON: the authors are `None`."""
    text = F.to_json(F.struct("text"))
    message = F.concat(
        F.lit("{'author_name': None, 'user_type': '"),
        F.col("user_type"),
        F.lit("', 'date': '"),
        F.col("date"),
        F.lit("', "),
        text.substr(F.lit(2), F.length(text)),
    )
    return _joined_transcripts(turns(spark, sf_dir).select("Key", "pos", message.alias("message")))


def chats_with_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats that have a conversation, with their transcripts."""
    return chats(spark, sf_dir).drop("Messages").join(transcripts(spark, sf_dir), "ID")


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase list: the distinct short messages."""
    return (
        table(spark, sf_dir, "conversations")
        .where(F.length("text") < 50)
        .select(F.col("text").alias("FilterMessages"))
        .distinct()
    )

