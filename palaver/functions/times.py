"""Time expressions on zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_hour(ts: Column) -> Column:
    """Nearest full hour; an exact half goes to the even hour.

    Works on the clock fields, so the session zone has no say. Seconds with their fraction, a
    decimal, are only looked at within the thirtieth minute.
    """
    hour, minute = F.hour(ts), F.minute(ts)
    past_half = (F.extract(F.lit("SECOND"), ts) > 0) | (hour % 2 == 1)
    up = (minute > 30) | ((minute == 30) & past_half)
    hours = F.when(up, hour + 1).otherwise(hour)
    return F.to_date(ts).cast("timestamp_ntz") + F.expr("INTERVAL '1' HOUR") * hours


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def midnight_after(ts: Column) -> Column:
    """First midnight strictly later than `ts`."""
    return F.date_add(F.to_date(ts), 1).cast("timestamp_ntz")


def run_stamp(at: Column | None = None) -> Column:
    from palaver.schemas import RUN_STAMP

    return F.date_format(F.current_timestamp() if at is None else at, RUN_STAMP)


def date_id(ts: Column) -> Column:
    """Day as a yyyymmdd integer."""
    return F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)
