"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")
LARGEST_DOUBLE = 1.7976931348623157e308


def minutes(seconds: Column, integer: bool = False) -> Column:
    """Seconds to minutes. The cast comes first: dividing decimals would fix the scale at six."""
    if integer:
        whole = seconds.cast("long")
        return F.floor(F.abs(whole) / 60).cast("long") * F.signum(whole).cast("long")
    return seconds.cast("double") / 60


def half_even(value: Column, places: int = 0) -> Column:
    return F.bround(value, places)


def is_finite(value: Column) -> Column:
    number = value.cast("double")
    return value.isNotNull() & ~F.isnan(number) & (F.abs(number) != INFINITY)


def inf_to_nan(value: Column) -> Column:
    return F.when(F.abs(value) == INFINITY, F.lit(float("nan"))).otherwise(value)


def nan_to_number(value: Column, number: float = 0.0) -> Column:
    """NaN becomes `number`, an infinity the largest double of its sign."""
    return (
        F.when(F.isnan(value), F.lit(number))
        .when(value == INFINITY, F.lit(LARGEST_DOUBLE))
        .when(value == -INFINITY, F.lit(-LARGEST_DOUBLE))
        .otherwise(value)
    )


def fill_gaps(value: Column, number: float = 999.0) -> Column:
    """Null, NaN and the infinities all become `number`."""
    return F.nanvl(F.coalesce(inf_to_nan(value), F.lit(number)), F.lit(number))
