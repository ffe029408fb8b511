"""Expressions on class-score arrays (order: Negative, Neutral, Positive)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.schemas import SENTIMENTS


def softmax(logits: Sequence[Column]) -> list[Column]:
    """Max-shifted softmax over a fixed number of score columns, without array lambdas."""
    top = F.greatest(*logits)
    powers = [F.exp(score - top) for score in logits]
    total = sum(powers[1:], powers[0])
    return [power / total for power in powers]


def softmax_array(logits: Column) -> Column:
    """The same for an array column of any length."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda score: F.exp(score - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, power: acc + power)
    return F.transform(powers, lambda power: power / total)


def argmax(scores: Column) -> Column:
    """Zero-based place of the highest score; the first one wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def label_of(index: Column, labels: Sequence[str] = SENTIMENTS) -> Column:
    """Name of a class index; an index outside the classes has an empty name."""
    names = F.array(*[F.lit(label) for label in labels])
    return F.coalesce(F.get(names, index), F.lit(""))


def best_label(scores: Column, labels: Sequence[str] = SENTIMENTS) -> Column:
    return label_of(argmax(scores), labels)


def score_map(scores: Column, labels: Sequence[str] = SENTIMENTS) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(label) for label in labels]), scores)


def ranked(scores: Sequence[Column], labels: Sequence[str] = SENTIMENTS) -> Column:
    """Array of (score, label) from the highest score down; equal scores keep class order."""
    entries = [
        F.struct((-score).alias("minus"), F.lit(place).alias("place"), F.lit(label).alias("label"))
        for place, (score, label) in enumerate(zip(scores, labels, strict=True))
    ]
    return F.transform(
        F.sort_array(F.array(*entries)),
        lambda entry: F.struct((-entry["minus"]).alias("score"), entry["label"].alias("label")),
    )


def very_positive(df_sentiment: Column, positive: Column, at_least: float = 0.8) -> Column:
    return F.coalesce((df_sentiment == "Positive") & (positive >= at_least), F.lit(False))
