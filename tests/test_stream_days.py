"""The streaming load with keyed state: copies, old chats, null keys, retries, and the days it reads."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from palaver.session import fresh_path
from palaver.streaming import loads

ROWS = "UserID long, ID string, Date timestamp_ntz, v string"
FACTS = "UserID long, ChatID string, Date timestamp_ntz, v string"


def chat(n, day, user=1, v="x"):
    return (user, None if n is None else str(n), None if day is None else datetime(2024, 1, day, 12), v)


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), FACTS)


@pytest.fixture
def place(spark):
    return {name: fresh_path(spark, name) for name in ("source", "table", "state")}


def arrive(spark, place, *rows):
    spark.createDataFrame(list(rows), ROWS).coalesce(1).write.mode("append").parquet(place["source"])


def run(spark, place, **options):
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(place["source"])
    to_facts = lambda rows: rows.withColumnRenamed("ID", "ChatID")
    loads.stream_merge_by_day(stream, to_facts, place["table"], place["state"], **options).awaitTermination()
    stored = spark.read.schema(f"{FACTS}, day date, batch long").parquet(place["table"]).collect()
    return sorted(((r.UserID, r.ChatID, r.Date.day if r.Date else None, r.v) for r in stored), key=repr)


def test_four_files_out_of_order(spark, place):
    loads.write_days(facts(spark, chat(1, 3, v="loaded"), chat(2, 4, v="loaded")), place["table"], -1)
    arrive(spark, place, chat(5, 9), chat(1, 3))
    arrive(spark, place, chat(3, 2), chat(5, 9, v="again"), chat(2, 4))
    arrive(spark, place, chat(4, 28), chat(6, 1))
    arrive(spark, place, chat(3, 2, v="again"), chat(4, 28, v="again"), chat(7, 15))
    expected = [(1, "1", 3, "loaded"), (1, "2", 4, "loaded")] + [(1, str(n), d, "x") for n, d in ((3, 2), (4, 28), (5, 9), (6, 1), (7, 15))]
    assert run(spark, place) == sorted(expected, key=repr)
    assert run(spark, place) == sorted(expected, key=repr)
    arrive(spark, place, chat(6, 1, v="late"), chat(8, None))  # far behind all others, and without a date
    assert run(spark, place) == sorted([*expected, (1, "8", None, "x")], key=repr)


def test_the_state_knows_a_copy_under_another_date(spark, place):
    arrive(spark, place, chat(1, 3))
    arrive(spark, place, chat(1, 4, v="moved"), chat(2, 4))
    assert run(spark, place) == [(1, "1", 3, "x"), (1, "2", 4, "x")]


def test_rows_without_a_whole_key_are_all_added(spark, place):
    arrive(spark, place, chat(None, 3), chat(None, 3), chat(1, 3, user=None))
    arrive(spark, place, chat(None, 3), chat(1, 3, user=None))
    assert run(spark, place) == [(1, None, 3, "x")] * 3 + [(None, "1", 3, "x")] * 2


def test_a_retried_batch_replaces_its_folders(spark, place):
    rows = facts(spark, chat(1, 3), chat(None, 3), chat(2, 4))
    for _ in range(2):
        loads.write_days(rows, place["table"], 5)
    assert spark.read.parquet(place["table"]).count() == 3
    loads.write_days(facts(spark, chat(9, 3)), place["table"], 6)
    assert spark.read.parquet(place["table"]).count() == 4


def test_a_check_stops_the_stream(spark, place):
    from pyspark.errors import StreamingQueryException

    def refuse(rows):
        raise ValueError("refused")

    arrive(spark, place, chat(1, 3))
    with pytest.raises(StreamingQueryException, match="refused"):
        run(spark, place, check=refuse)


def test_only_the_days_of_a_batch_are_read(spark, place):
    loads.write_days(facts(spark, *[chat(n, 1 + n % 28) for n in range(200)], chat(500, None)), place["table"], 0)
    schema = spark.createDataFrame([], FACTS).schema
    stored = loads.stored_days(spark, place["table"], schema, [date(2024, 1, 3), date(2024, 1, 5)])
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    days = {r.f.split("day=")[1].split("/")[0] for r in stored.select(F.input_file_name().alias("f")).distinct().collect()}
    assert days == {"2024-01-03", "2024-01-05"}
    undated = loads.stored_days(spark, place["table"], schema, [None])
    assert [r.ChatID for r in undated.collect()] == ["500"]


def test_the_state_store_setting_is_put_back(spark, place):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    arrive(spark, place, chat(1, 3))
    run(spark, place)
    assert spark.conf.get(key) == before


def test_a_batch_writes_a_file_for_a_day_not_one_for_a_task_and_day(spark, place):
    for start in (0, 1000):
        arrive(spark, place, *[chat(start + n, 1 + n % 20, user=n) for n in range(600)])
    assert len(run(spark, place)) == 1200
    files = {r.f for r in spark.read.parquet(place["table"]).select(F.input_file_name().alias("f")).distinct().collect()}
    assert 40 <= len(files) < 60  # twenty days of two batches
