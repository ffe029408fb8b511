"""Distinct counts under any filter, from sketches kept per day and dimension.

A sketch (HyperLogLog, Spark's own) of each counted column is stored for every day and combination
of dimensions, once, when the day is loaded. A question picks sketches by their day and
dimensions and unites them; the chats themselves are not read. Loads add sketches, and sketches
of one group from several loads unite like any others.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.operators.filters import ChatFilter

BITS = 12  # of the register number: 4,096 registers a sketch
COLUMNS = ("UserID", "ChatID")
DIMENSIONS = ("Brand", "CountryGroup1", "Sentiment")


def error_bound(bits: int = BITS, deviations: float = 4.0) -> float:
    """The relative error that united sketches keep to: so many standard deviations of 1.04 / sqrt(registers)."""
    return deviations * 1.04 / math.sqrt(2**bits)


def daily_sketches(
    facts: DataFrame, columns: Sequence[str] = COLUMNS, dimensions: Sequence[str] = DIMENSIONS, date: str = "Date", bits: int = BITS
) -> DataFrame:
    """day, the dimensions, chats, and a sketch of each column: one row per group that occurs.

    Columns of whole numbers and texts are counted; nulls are not, as with an exact count. Sketches
    are combined on the map side, so a group with most of the rows is as good as any other.
    """
    counted = [F.hll_sketch_agg(F.col(c), F.lit(bits)).alias(f"{c}_sketch") for c in columns]
    return facts.groupBy(F.to_date(date).alias("day"), *dimensions).agg(F.count("*").alias("chats"), *counted)


def picked(sketches: DataFrame, chosen: ChatFilter) -> DataFrame:
    """The sketches that a filter covers. It may name days and the stored dimensions, nothing else.

    A date bound must be a midnight, and an upper one needs `end_inclusive_day`: sketches do not tell
    moments of a day apart.
    """
    fields = {"countries": "CountryGroup1", "brands": "Brand", "sentiments": "Sentiment", "chat_types": "ChatType", "agents": "AgentDisplayName"}
    for name, column in fields.items():
        if getattr(chosen, name) and column not in sketches.columns:
            raise ValueError(f"no sketches by {column}")
    if chosen.duration != (None, None) or chosen.search or (chosen.vip != (None, None) and "VIPLevel" not in sketches.columns):
        raise ValueError("sketches are picked by day and stored dimension only")
    low, high = chosen.date
    if any(bound is not None and len(bound) != 10 for bound in chosen.date) or (high is not None and not chosen.end_inclusive_day):
        raise ValueError("sketches are picked by whole days")
    days = sketches.where(F.col("day") >= F.lit(low).cast("date")) if low is not None else sketches
    days = days.where(F.col("day") <= F.lit(high).cast("date")) if high is not None else days
    rest = ChatFilter(
        countries=chosen.countries, brands=chosen.brands, sentiments=chosen.sentiments, chat_types=chosen.chat_types,
        agents=chosen.agents, vip=chosen.vip,
    )
    return rest.apply(days)


def united(sketches: DataFrame, columns: Sequence[str] = COLUMNS, by: Sequence[str] = ()) -> DataFrame:
    """The columns `by`, chats, and the estimated number of distinct values of each column."""
    counted = [F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(c) for c in columns]
    return sketches.groupBy(*by).agg(F.coalesce(F.sum("chats"), F.lit(0)).alias("chats"), *counted)


def estimates(sketches: DataFrame, chosen: ChatFilter, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """(column_name, distinct_values) under a filter, estimated; 0 where nothing is left."""
    one = united(picked(sketches, chosen), columns).select(*(F.coalesce(c, F.lit(0)).alias(c) for c in columns))
    return one.unpivot([], list(columns), "column_name", "distinct_values")
