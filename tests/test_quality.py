from datetime import date

import pytest
from pyspark.sql import Observation

from palaver.operators import merge, quality
from palaver.session import fresh_path
from palaver.sources import sinks

NAN, INF = float("nan"), float("inf")


def kinds(df):
    return dict(df.dtypes)


def test_integer_bounds_are_strict(spark):
    rows = [(126, 127, 32766, 32767, 1, 2**40, None), (-127, 0, 0, 0, 1, 0, None)]
    df = spark.createDataFrame(rows, "a long, b long, c int, d long, e tinyint, f long, g long")
    assert kinds(quality.narrow_types(df)) == {
        "a": "tinyint", "b": "smallint", "c": "smallint", "d": "int", "e": "tinyint", "f": "bigint", "g": "bigint",
    }


def test_floats_narrow_only_without_loss(spark):
    rows = [(0.5, 0.1, None, NAN), (0.25, 0.5, None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    narrow = quality.narrow_types(df)
    assert kinds(narrow) == {"a": "float", "b": "double", "c": "double", "d": "float"}
    assert sorted(r.a for r in narrow.collect()) == [0.25, 0.5]


def test_narrow_leaves_texts_and_empty_frames(spark):
    df = spark.createDataFrame([], "a long, s string, `x.y` double")
    assert kinds(quality.narrow_types(df)) == {"a": "bigint", "s": "string", "x.y": "double"}


def test_gate_names_columns_and_counts(spark):
    df = spark.createDataFrame([(1, None), (2, None), (None, "x")], "a int, b string")
    with pytest.raises(quality.NullsFound, match="'a': 1.*'b': 2"):
        quality.require_no_nulls(df)
    assert quality.require_no_nulls(quality.impute(df, {"a": 0, "b": ""})).count() == 3
    assert quality.require_no_nulls(df.limit(0)).count() == 0


def test_clean_numbers(spark):
    df = spark.createDataFrame([(1.0, 1), (NAN, 2), (INF, 3), (-INF, 4), (None, 5), (2.0, None)], "a double, b int")
    cleaned = quality.clean_numbers(df)
    assert kinds(cleaned) == {"a": "double", "b": "double"}
    assert [tuple(r) for r in cleaned.collect()] == [(1.0, 1.0)]


def test_finite_census(spark):
    df = spark.createDataFrame([(1.0, 1.0), (NAN, 2.0), (INF, None)], "a double, b double")
    census = {r.column_name: (r.nan_count, r.inf_count, r.finite_count) for r in quality.finite_census(df).collect()}
    assert census == {"a": (1, 1, 1), "b": (0, 0, 2)}
    flags = quality.all_finite(df).first()
    assert (flags.all_finite, flags.any_finite) == (False, True)


def test_distinct_and_repeated(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "a int, b string")
    assert {tuple(r) for r in quality.distinct_counts(df).collect()} == {("a", 2), ("b", 2)}
    assert {tuple(r) for r in quality.distinct_counts(df, approximate=True).collect()} == {("a", 2), ("b", 2)}
    assert [tuple(r) for r in quality.repeated_keys(df, "a").collect()] == [(1, 2)]
    assert {r.b for r in quality.distinct_values(df, "b").collect()} == {"x", "y", None}
    assert quality.complete_rows(df, "b").count() == 2


def test_ranges_come_from_footers(spark):
    path = fresh_path(spark, "ranges")
    rows = [(1, date(2024, 1, 2), 5, "a", 0.5), (None, date(1969, 12, 31), -7, "b", 1.5), (2**40, None, 0, None, None)]
    df = spark.createDataFrame(rows, "a long, d date, c tinyint, s string, x double")
    df.repartition(3).write.parquet(path)
    settings = {key: spark.conf.get(key) for key in quality.FOOTER_SETTINGS}
    found = {r.column_name: (r.low, r.high) for r in quality.ranges_from_footers(spark, path).collect()}
    assert found == {"a": (1.0, float(2**40)), "d": (-1.0, 19724.0), "c": (-7.0, 5.0)}
    assert {key: spark.conf.get(key) for key in settings} == settings
    assert [tuple(r) for r in quality.ranges_from_footers(spark, path, ["c"]).collect()] == [("c", -7.0, 5.0)]
    with pytest.raises(ValueError, match="'x'"):
        quality.ranges_from_footers(spark, path, ["x"])
    assert {key: spark.conf.get(key) for key in settings} == settings
    empty = fresh_path(spark, "ranges")
    df.limit(0).write.parquet(empty)
    assert [tuple(r) for r in quality.ranges_from_footers(spark, empty, ["a"]).collect()] == [("a", None, None)]


def test_a_write_observes_what_gate_and_audit_need(spark):
    rows = [(0.2, 0.3, 0.5, "x"), (0.4, 0.3, 0.3, None), (0.6, None, 0.1, "y")]
    scored = spark.createDataFrame(rows, "Negative double, Neutral double, Positive double, `a.b` string").repartition(3)
    run, observed = sinks.write_observed_stage(scored, fresh_path(spark, "stage"), ["Negative", "Neutral", "Positive"])
    assert observed["rows"] == 3 and observed["nulls a.b"] == 1 and observed["nulls Negative"] == 0
    with pytest.raises(quality.NullsFound, match="'Neutral': 1.*'a.b': 1"):
        quality.require_none_observed(observed)
    told = merge.observed_audit_row(spark, observed, "p", "predict", run).collect()
    assert told == merge.audit_row(scored, "p", "predict", run).collect()
    empty, observed = sinks.write_observed_stage(scored.limit(0), fresh_path(spark, "stage"), ["Negative", "Neutral", "Positive"])
    quality.require_none_observed(observed)
    assert merge.observed_audit_row(spark, observed, "p", "train").collect() == merge.audit_row(scored.limit(0), "p", "train").collect()


def test_observed_metrics_are_those_of_the_frame(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "n int, s string")
    watch = Observation()
    df.observe(watch, *quality.observed_metrics(df, ["n"])).collect()
    assert watch.get == {"rows": 2, "nulls n": 1, "nulls s": 2, "mean n": 1.0}
