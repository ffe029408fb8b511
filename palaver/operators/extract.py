"""Extraction: chats joined to profiles, and the windows that decide which chats to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.numbers import minutes
from palaver.functions.times import days_before, midnight_after
from palaver.schemas import AGENT_COLUMN, CHATBOT_CHAT, SUPPORT_CHAT


def chat_type(tags: Column) -> Column:
    """Chats tagged as chatbot, in any case; an untagged chat is a support chat."""
    return F.when(tags.ilike("%chatbot%"), CHATBOT_CHAT).otherwise(SUPPORT_CHAT)


def chats_with_profile(
    chats: DataFrame,
    profile: DataFrame,
    integer_minutes: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Chats with the attributes of their user, under analytic names. Chats without a profile stay.

    The join carries no hint: a profile table small enough is broadcast from its known size, a
    large one is shuffled with its key and AQE splits the partition of a user with very many chats.
    """
    left = chats.where(F.col("ID").isNotNull())
    return left.join(profile, "UserID", "left").select(
        "ID",
        "UserID",
        F.col("VIPlevelNo").alias("VIPLevel"),
        "Messages",
        F.col("rate").alias("Rating"),
        minutes(F.col("duration"), integer_minutes).alias("DurationInMins"),
        F.col("BrandFriendlyName").alias("Brand"),
        "CountryGroup1",
        F.col("started").alias("Date"),
        "AgentMessagesCount",
        "VisitorMessagesCount",
        chat_type(F.col("tags")).alias("ChatType"),
        F.col(f"`{AGENT_COLUMN}`").alias("AgentDisplayName"),
        *keep,
    )


def _moment(as_of: Column | str | None) -> Column:
    if as_of is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of


def started_within(chats: DataFrame, as_of: Column | str | None = None, days: int = 10) -> DataFrame:
    """Chats of the last `days` days."""
    return chats.where(F.col("started") > days_before(_moment(as_of), days))


def max_loaded(fact: DataFrame) -> DataFrame:
    """Newest loaded chat time, one row."""
    return fact.agg(F.max("Date").alias("max_date"))


def not_yet_loaded(
    chats: DataFrame,
    fact: DataFrame,
    as_of: Column | str | None = None,
    days: int = 30,
    mode: str = "timestamp",
) -> DataFrame:
    """Chats later than anything loaded; with an empty fact table, those of the last `days` days.

    `mode="day"` compares whole days: what is left of the day of the newest loaded chat is then
    not taken. Either way the bare column is compared with one scalar subquery, whose value the
    scan of the chats gets at run time to skip row groups.
    """
    newest = F.coalesce(F.col("max_date"), days_before(_moment(as_of), days))
    if mode == "timestamp":
        return chats.where(F.col("started") > max_loaded(fact).select(newest).scalar())
    if mode == "day":
        return chats.where(F.col("started") >= max_loaded(fact).select(midnight_after(newest)).scalar())
    raise ValueError(f"unknown mode {mode!r}")


def new_users(chats: DataFrame, fact: DataFrame) -> DataFrame:
    """Chats of users who are not in the fact table at all."""
    known = fact.select("UserID").where(F.col("UserID").isNotNull()).distinct()
    return chats.join(known, "UserID", "left_anti")
