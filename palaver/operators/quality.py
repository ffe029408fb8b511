"""Data quality: imputing, null gates, censuses, type narrowing."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.functions.numbers import is_finite
from palaver.schemas import IMPUTED

# Exclusive bounds of the integer types, narrowest first.
INTEGER_RANGES = (
    ("tinyint", -128, 127),
    ("smallint", -32768, 32767),
    ("int", -2147483648, 2147483647),
)


class NullsFound(ValueError):
    """Raised by the null gate; names the columns and how many nulls each holds."""


def _numeric(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _quoted(name: str):
    return F.col(f"`{name}`")


def impute(df: DataFrame, values: dict | None = None) -> DataFrame:
    values = IMPUTED if values is None else values
    return df.na.fill({name: value for name, value in values.items() if name in df.columns})


def _as_rows(one_row: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """The columns of a one-row frame as (name, value) rows."""
    return one_row.unpivot([], [_quoted(c) for c in columns], name, value)


def null_census(df: DataFrame) -> DataFrame:
    """(column_name, nulls), in one pass."""
    counts = df.agg(*[F.count_if(_quoted(c).isNull()).alias(c) for c in df.columns])
    return _as_rows(counts, df.columns, "column_name", "nulls")


def require_no_nulls(df: DataFrame) -> DataFrame:
    """Return the frame unchanged, or raise with the columns that hold nulls."""
    found = {r["column_name"]: r["nulls"] for r in null_census(df).where("nulls > 0").collect()}
    if found:
        raise NullsFound(f"nulls before load: {found}")
    return df


def observed_metrics(df: DataFrame, means: Sequence[str] = ()) -> list:
    """What a gate and an audit need to know of a frame, as metrics for `DataFrame.observe`.

    The number of rows, the nulls of every column, the means of the columns `means`. They are
    gathered by the job that writes the frame, in the tasks that write it: nothing is read again.
    """
    nulls = [F.count_if(_quoted(c).isNull()).alias(f"nulls {c}") for c in df.columns]
    return [F.count(F.lit(1)).alias("rows"), *nulls, *(F.avg(_quoted(c)).alias(f"mean {c}") for c in means)]


def require_none_observed(observed: dict) -> None:
    """The null gate over observed metrics: raises what `require_no_nulls` would."""
    found = {name.removeprefix("nulls "): n for name, n in observed.items() if name.startswith("nulls ") and n}
    if found:
        raise NullsFound(f"nulls before load: {found}")


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column_name, distinct_values). `approximate` keeps a sketch per column instead of a shuffle."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    counts = df.agg(*[count(_quoted(c)).alias(c) for c in df.columns])
    return _as_rows(counts, df.columns, "column_name", "distinct_values")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(_quoted(column).alias(column)).distinct()


FOOTER_SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def ranges_from_footers(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, low, high) of columns of a stored Parquet table, from the bounds in its footers: no row is read.

    For columns of whole numbers and dates (all of them by default; dates as days since 1970), whose
    bounds the format keeps exactly; others are refused. Spark plans it where its newer reader and
    aggregate push-down are on: they are, while the one row is fetched.
    """
    before = {key: spark.conf.get(key, None) for key in FOOTER_SETTINGS}
    try:
        for key, setting in FOOTER_SETTINGS.items():
            spark.conf.set(key, setting)
        table = spark.read.parquet(path)
        kinds = {f.name: f.dataType for f in table.schema.fields if isinstance(f.dataType, (T.IntegralType, T.DateType))}
        chosen = list(kinds if columns is None else columns)
        if refused := [c for c in chosen if c not in kinds]:
            raise ValueError(f"no exact bounds in footers for {refused}")
        bounds = table.agg(*[f(_quoted(c)).alias(f"{name} {c}") for c in chosen for name, f in (("low", F.min), ("high", F.max))])
        plan = bounds._jdf.queryExecution().executedPlan().toString()
        if "PushedAggregation: []" in plan:
            raise RuntimeError("the aggregate was not pushed to the footers")
        row = bounds.first()
    finally:
        for key, setting in before.items():
            spark.conf.unset(key) if setting is None else spark.conf.set(key, setting)

    def number(value: object) -> float | None:
        return None if value is None else float((value - date(1970, 1, 1)).days if isinstance(value, date) else value)

    rows = [(c, number(row[f"low {c}"]), number(row[f"high {c}"])) for c in chosen]
    return spark.createDataFrame(rows, "column_name string, low double, high double")


def numeric_ranges(df: DataFrame) -> DataFrame:
    """(column_name, low, high) of every numeric column, as doubles."""
    fields = _numeric(df)
    bounds = df.agg(
        *[
            F.struct(
                F.min(_quoted(f.name)).cast("double").alias("low"), F.max(_quoted(f.name)).cast("double").alias("high")
            ).alias(f.name)
            for f in fields
        ]
    )
    rows = _as_rows(bounds, [f.name for f in fields], "column_name", "bounds")
    return rows.select("column_name", "bounds.low", "bounds.high")


def _narrow_plan(df: DataFrame) -> dict[str, str]:
    """Target type per numeric column, from one aggregate over the data."""
    fields = [f for f in _numeric(df) if not isinstance(f.dataType, (T.ByteType, T.DecimalType))]
    if not fields:
        return {}
    aggregates = []
    for f in fields:
        column = _quoted(f.name)
        if isinstance(f.dataType, T.IntegralType):
            aggregates.append(F.struct(F.min(column).alias("low"), F.max(column).alias("high")).alias(f.name))
        else:
            number = column.cast("double")
            fits = F.isnan(number) | (number.cast("float").cast("double") == number)
            aggregates.append(F.struct(F.bool_and(fits).alias("fits")).alias(f.name))
    seen = df.agg(*aggregates).first()
    plan = {}
    for f in fields:
        bounds = seen[f.name]
        if isinstance(f.dataType, T.IntegralType):
            if bounds["low"] is None:
                continue
            for kind, low, high in INTEGER_RANGES:
                if low < bounds["low"] and bounds["high"] < high:
                    plan[f.name] = kind
                    break
        else:
            plan[f.name] = "float" if bounds["fits"] else "double"
    return plan


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast numeric columns to the smallest type that holds every value.

    Integers need bounds strictly inside the type; floats narrow only where no value changes. An
    all-null float column becomes double, byte and decimal columns stay.
    """
    plan = _narrow_plan(df)
    return df.select(
        *[_quoted(c).cast(plan[c]).alias(c) if c in plan else _quoted(c) for c in df.columns]
    )


def narrow_report(df: DataFrame) -> DataFrame:
    """(column_name, low, high, narrow_type): what `narrow_types` would choose for integers."""
    integral = [f.name for f in _numeric(df) if isinstance(f.dataType, T.IntegralType)]
    ranges = numeric_ranges(df.select(*[_quoted(c) for c in integral]))
    choice = F.lit("bigint")
    for kind, low, high in reversed(INTEGER_RANGES):
        choice = F.when((F.col("low") > low) & (F.col("high") < high), kind).otherwise(choice)
    return ranges.withColumn("narrow_type", choice)


def clean_numbers(df: DataFrame) -> DataFrame:
    """Rows without null, NaN or infinity, every column as double."""
    keep = df
    for c in df.columns:
        keep = keep.where(is_finite(_quoted(c)))
    return keep.select(*[_quoted(c).cast("double").alias(c) for c in df.columns])


def complete_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with no null in the chosen columns."""
    return df.na.drop(subset=list(columns) or None)


def finite_census(df: DataFrame) -> DataFrame:
    """Per numeric column: NaN, infinite and finite counts; the columns with most NaN come last."""
    fields = [f.name for f in _numeric(df)]
    counts = df.agg(
        *[
            F.struct(
                F.count_if(F.isnan(_quoted(c).cast("double"))).alias("nan_count"),
                F.count_if(F.abs(_quoted(c).cast("double")) == float("inf")).alias("inf_count"),
                F.count_if(is_finite(_quoted(c))).alias("finite_count"),
            ).alias(c)
            for c in fields
        ]
    )
    rows = _as_rows(counts, fields, "column_name", "census")
    return rows.select("column_name", "census.*").orderBy("nan_count", "column_name")


def all_finite(df: DataFrame) -> DataFrame:
    """One row: are all, and are any, of the numbers finite."""
    fields = [f.name for f in _numeric(df)]
    flags = [is_finite(_quoted(c)) for c in fields]
    return df.agg(
        F.bool_and(F.array_min(F.array(*flags))).alias("all_finite"),
        F.bool_or(F.array_max(F.array(*flags))).alias("any_finite"),
    )


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts: a profile must have none."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")
