"""Sketches of distinct counts and summaries of frequent texts."""

from collections import Counter
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palaver.operators import frequent, sketches
from palaver.operators.filters import ChatFilter
from palaver.operators.transcripts import top_messages
from test_filters import fact


def many(spark, n=30_000):
    return spark.range(n).select(
        F.pmod(F.xxhash64("id"), F.lit(9000)).alias("UserID"), F.col("id").cast("string").alias("ChatID"),
        (F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("Date"),
        F.concat(F.lit("B"), (F.col("id") % 3).cast("string")).alias("Brand"), F.lit("EU").alias("CountryGroup1"),
        F.when(F.col("id") % 2 == 0, "Positive").alias("Sentiment"),
    )


def test_sketches_under_filters_come_close(spark):
    facts = many(spark)
    stored = sketches.daily_sketches(facts)
    assert stored.count() == 21 * 3 * 2
    for chosen in (
        ChatFilter(),
        ChatFilter(brands=["B1"]),
        ChatFilter(sentiments=["Positive"], date=("2024-01-03", "2024-01-09"), end_inclusive_day=True),
        ChatFilter(date=("2024-01-20", None)),
    ):
        found = {r.column_name: r.distinct_values for r in sketches.estimates(stored, chosen).collect()}
        for column in sketches.COLUMNS:
            exact = chosen.apply(facts).select(column).distinct().count()
            assert abs(found[column] - exact) <= 1 + sketches.error_bound() * exact
    by_brand = sketches.united(stored, by=["Brand"]).collect()
    assert sorted(r.Brand for r in by_brand) == ["B0", "B1", "B2"] and sum(r.chats for r in by_brand) == 30_000


def test_sketches_of_loads_unite(spark):
    facts = many(spark, 4000)
    parts = [sketches.daily_sketches(facts.where(F.col("UserID") % 3 == k)) for k in range(3)]
    whole = {r.column_name: r.distinct_values for r in sketches.estimates(sketches.daily_sketches(facts), ChatFilter()).collect()}
    union = parts[0].union(parts[1]).union(parts[2])
    found = {r.column_name: r.distinct_values for r in sketches.estimates(union, ChatFilter()).collect()}
    assert all(abs(found[c] - whole[c]) <= 2 + 0.02 * whole[c] for c in whole)


def test_sketches_of_nulls_and_nothing(spark):
    rows = fact(spark, {"UserID": None, "Date": None}, {"UserID": 3}, {"UserID": 3, "Brand": None})
    found = {r.column_name: r.distinct_values for r in sketches.estimates(sketches.daily_sketches(rows), ChatFilter()).collect()}
    assert found == {"UserID": 1, "ChatID": 3}
    none = sketches.estimates(sketches.daily_sketches(rows.limit(0)), ChatFilter()).collect()
    assert [r.distinct_values for r in none] == [0, 0]


@pytest.mark.parametrize(
    "chosen",
    [ChatFilter(agents=["A"]), ChatFilter(search="x"), ChatFilter(duration=(1, 2)), ChatFilter(vip=(1, 2)),
     ChatFilter(date=("2024-01-01 10:00:00", None)), ChatFilter(date=(None, "2024-01-02"))],
)
def test_sketches_refuse_what_they_cannot_tell(spark, chosen):
    with pytest.raises(ValueError):
        sketches.picked(sketches.daily_sketches(fact(spark, {})), chosen)


def texts(spark, rows):
    return spark.createDataFrame([(t,) for t in rows], "text string")


def test_summaries_bound_every_count():
    """What a summary gives, and what it says may be missing, hold for every value."""
    values = [n % 7 for n in range(2000)] + [100 + n for n in range(3000)]
    values = [values[k * 37 % len(values)] for k in range(len(values))]
    batches = [pa.RecordBatch.from_arrays([pa.array(values[k : k + 50], pa.int64())], ["mark"]) for k in range(0, len(values), 50)]
    (out,) = frequent.summarise(iter(batches), 20)
    told = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    slack = told.pop(None)
    assert 0 < slack <= len(values) / 20 and len(told) <= 40
    for value, n in Counter(values).items():
        assert told.get(value, 0) <= n <= told.get(value, 0) + slack


def test_frequent_texts_are_the_exact_ones(spark):
    rows = [f"often {n}" for n in range(5) for _ in range(300 + n)] + [f"once {n}" for n in range(2000)] + [None] * 500
    df = texts(spark, rows).repartition(4, F.rand(1))
    for n, counters, expected in ((5, 200, True), (3, 200, True), (5, 4000, True), (100, 200, False), (6, 200, False)):
        found, proven = frequent.frequent_messages(df, n, counters)
        assert [tuple(r) for r in found.collect()] == [tuple(r) for r in top_messages(df, n).collect()]
        assert proven == expected, (n, counters)


def test_frequent_texts_of_few_and_none(spark):
    found, proven = frequent.frequent_messages(texts(spark, ["b", "a", "b", None]), 10)
    assert proven and [tuple(r) for r in found.collect()] == [("b", 2), ("a", 1)]
    found, proven = frequent.frequent_messages(texts(spark, [None]), 10)
    assert proven and found.count() == 0
    found, _ = frequent.frequent_messages(texts(spark, ["b", "a", "c"]), 2)  # a tie at the end
    assert [tuple(r) for r in found.collect()] == [("a", 1), ("b", 1)]


def test_the_exact_pass_shuffles_candidates_only(spark):
    df = texts(spark, [f"often {n % 3}" for n in range(900)] + [f"once {n}" for n in range(5000)])
    spark.sparkContext.setJobGroup("frequent", "")
    found, proven = frequent.frequent_messages(df, 3, 100)
    assert proven and found.count() == 3
