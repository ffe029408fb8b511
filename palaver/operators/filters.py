"""Chat filters: one predicate out of many optional choices, and trailing date ranges."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.schemas import ALL_AGENTS, ALL_BRANDS, ALL_COUNTRIES, SUPPORT_CHAT


def one_of(column: str, chosen: Collection[str] = (), everything: str | None = None) -> Column | None:
    """Membership in the chosen values. No choice, or the "all" entry among them, is no filter."""
    if not chosen or (everything is not None and everything in chosen):
        return None
    return F.col(column).isin(list(chosen))


def within(column: str, low: object = None, high: object = None) -> list[Column]:
    """Inclusive bounds; a bound that is not set does not filter."""
    bounds = []
    if low is not None:
        bounds.append(F.col(column) >= F.lit(low))
    if high is not None:
        bounds.append(F.col(column) <= F.lit(high))
    return bounds


@dataclass(frozen=True)
class ChatFilter:
    """Choices of a dashboard or search page. Everything left out does not filter.

    `date` bounds are inclusive moments, so a day as the upper bound means its midnight, unless
    `end_inclusive_day` is set. `search` is a case-sensitive regular expression.
    """

    date: tuple[str | None, str | None] = (None, None)
    countries: Collection[str] = ()
    brands: Collection[str] = ()
    vip: tuple[int | None, int | None] = (None, None)
    chat_types: Collection[str] = ()
    sentiments: Collection[str] = ()
    duration: tuple[float | None, float | None] = (None, None)
    agents: Collection[str] = ()
    search: str = ""
    search_column: str = "html_text"
    end_inclusive_day: bool = False

    def _date_bounds(self) -> list[Column]:
        low, high = (None if b is None else F.lit(b).cast("timestamp_ntz") for b in self.date)
        if high is None or not self.end_inclusive_day:
            return within("Date", low, high)
        next_day = F.date_add(F.to_date(high), 1).cast("timestamp_ntz")
        return [*within("Date", low), F.col("Date") < next_day]

    def predicate(self) -> Column:
        """The conjunction of all choices: plain comparisons, which reach the scan."""
        optional = [
            *self._date_bounds(),
            one_of("CountryGroup1", self.countries, ALL_COUNTRIES),
            one_of("Brand", self.brands, ALL_BRANDS),
            *within("VIPLevel", *self.vip),
            one_of("ChatType", self.chat_types),
            one_of("Sentiment", self.sentiments),
            *within("DurationInMins", *self.duration),
            one_of("AgentDisplayName", self.agents, ALL_AGENTS),
            F.col(self.search_column).rlike(self.search) if self.search else None,
        ]
        return reduce(Column.__and__, [p for p in optional if p is not None], F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate())


# Trailing ranges, back from the newest chat.
RANGE_PRESETS = {
    "7d": "INTERVAL '7' DAY",
    "1m": "INTERVAL '1' MONTH",
    "6m": "INTERVAL '6' MONTH",
    "1y": "INTERVAL '1' YEAR",
}


def trailing_range(df: DataFrame, preset: str) -> DataFrame:
    """Chats within a preset range that ends at the newest chat."""
    if preset == "all":
        return df
    newest = df.agg(F.max("Date").alias("newest"))
    if preset == "ytd":
        start = F.trunc(F.to_date("newest"), "year").cast("timestamp_ntz")
    else:
        start = F.col("newest") - F.expr(RANGE_PRESETS[preset])
    return df.where(F.col("Date") >= newest.select(start).scalar())


def support_chats(df: DataFrame) -> DataFrame:
    return df.where(F.col("ChatType") == SUPPORT_CHAT)


def chats_of_user(df: DataFrame, user_id: int) -> DataFrame:
    return df.where(F.col("UserID") == user_id)


def chat_by_id(df: DataFrame, chat_id: str) -> DataFrame:
    return df.where(F.col("ChatID") == chat_id)
