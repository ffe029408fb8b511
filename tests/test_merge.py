import uuid
from datetime import datetime

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from palaver.operators import merge
from palaver.plans import jobs
from palaver.schemas import FACT, FACT_TABLE, NEAREST
from palaver.session import fresh_path
from palaver.sources import sinks

SCHEMA = "UserID long, ChatID string, Date int, v string"
KEYS = ["UserID", "ChatID"]


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_insert_only_merge(spark):
    target = frame(spark, (1, "a", 1, "old"), (None, "n", 1, "old"))
    source = frame(
        spark,
        (1, "a", 2, "ignored"),
        (1, "b", 3, "later"),
        (1, "b", 2, "first"),
        (None, "n", 2, "again"),
        (2, None, 2, "x"),
        (2, None, 2, "x"),
    )
    new = merge.rows_to_insert(source, target, KEYS, ["Date"])
    expected = [(1, "b", 2, "first"), (None, "n", 2, "again"), (2, None, 2, "x"), (2, None, 2, "x")]
    assert rows(new) == sorted(expected, key=repr)


def test_keys_of_the_batch_thin_out_the_target(spark):
    target = frame(spark, *[(n, str(n), 1, "old") for n in range(50)], (None, "n", 1, "old"))
    source = frame(spark, (1, "1", 2, "skip"), (99, "new", 2, "x"), (99, "new", 3, "y"), (None, "n", 2, "z"))
    new = merge.rows_to_insert(source, target, KEYS, ["Date"])
    assert rows(new) == sorted([(99, "new", 2, "x"), (None, "n", 2, "z")], key=repr)
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Aggregate") < plan.index("LeftAnti")  # what is loaded goes first


def test_the_source_of_a_merge_runs_once(spark):
    """The pipeline behind the source feeds three branches and is evaluated for none of them again."""
    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            ran.add(len(batch))
            yield batch

    source = frame(spark, (1, "a", 1, "x"), (2, "b", 1, "y"), (None, "c", 1, "z")).mapInPandas(counted, SCHEMA)
    target = frame(spark, (1, "a", 0, "old"))
    assert merge.rows_to_insert(source, target, KEYS, ["Date"]).count() == 2
    assert ran.value == 3
    stored = fresh_path(spark, "source")
    source.write.parquet(stored)
    plan = merge.rows_to_insert(spark.read.parquet(stored), target, KEYS, ["Date"], store=False)._jdf.queryExecution().toString()
    assert "merge-source" not in plan


def test_second_run_adds_only_null_keys(spark):
    source = frame(spark, (1, "a", 1, "x"), (1, "b", 1, "y"), (None, "c", 1, "z"))
    once = merge.insert_only_merge(source, frame(spark).limit(0), KEYS, ["Date"])
    twice = merge.insert_only_merge(source, once, KEYS, ["Date"])
    assert once.count() == 3
    assert rows(merge.rows_to_insert(source, once, KEYS, ["Date"])) == [(None, "c", 1, "z")]
    assert twice.count() == 4


def test_ties_resolve_the_same_way_each_time(spark):
    source = frame(spark, *[(1, "a", 1, str(n)) for n in range(50)])
    picks = {rows(merge.first_per_key(source.repartition(n), KEYS, ["Date"]))[0] for n in (1, 3, 8)}
    assert len(picks) == 1


def test_nearest_players(spark):
    kinds = "UserID_newplayers long, UserID_vip long, distance double, Country string, RN int"
    batch = spark.createDataFrame([(1, 9, 0.5, "MT", 1), (1, 9, 0.4, "MT", 1), (1, 8, 0.7, "MT", 2)], kinds)
    target = spark.createDataFrame([(1, 7, 0.9, "MT", 2)], NEAREST)
    assert rows(merge.merge_nearest(batch, target)) == [(1, 7, 0.9, "MT", 2), (1, 9, 0.4, "MT", 1)]


def test_backfill_takes_the_first_non_null(spark):
    target = frame(spark, (1, "a", 0, None), (1, "a", 1, "kept"), (2, "b", 0, None), (None, "a", 0, None))
    source = spark.createDataFrame(
        [(1, "a", 1, None), (1, "a", 2, "fill"), (1, "a", 3, "late"), (None, "a", 1, "no")],
        "UserID long, ChatID string, at int, v string",
    )
    filled = merge.backfill_nulls(target, source, KEYS, "v", "at")
    expected = [(1, "a", 0, "fill"), (1, "a", 1, "kept"), (2, "b", 0, None), (None, "a", 0, None)]
    assert rows(filled) == sorted(expected, key=repr)


def test_backfill_rewrites_the_partitions_with_something_to_fill(spark):
    path = fresh_path(spark, "parts")
    table = spark.createDataFrame(
        [(1, "a", None, 1), (2, "b", "kept", 1), (3, "c", None, 2), (None, "d", None, 3), (4, "e", "full", 4), (5, "f", None, None)],
        "UserID long, ChatID string, v string, day int",
    )
    table.write.partitionBy("day").parquet(path)
    stored = lambda: spark.read.schema(table.schema).parquet(path)
    files = lambda: {f.split("day=")[1].split("/")[0]: f for f in stored().inputFiles()}
    before = files()
    source = spark.createDataFrame([(1, 2, "late"), (1, 1, "fill"), (4, 1, "no"), (5, 1, "five"), (9, 1, "x"), (3, 1, None)], "UserID long, at int, v string")
    touched = jobs.backfill_partitions(spark, path, table.schema, "day", source, ["UserID"], "v", "at")
    assert sorted(touched, key=repr) == [1, None]
    expected = [(1, "a", "fill", 1), (2, "b", "kept", 1), (3, "c", None, 2), (None, "d", None, 3), (4, "e", "full", 4), (5, "f", "five", None)]
    assert rows(stored()) == sorted(expected, key=repr)
    after = files()
    assert {day for day in before if before[day] != after[day]} == {"1", "__HIVE_DEFAULT_PARTITION__"}
    assert jobs.backfill_partitions(spark, path, table.schema, "day", source, ["UserID"], "v", "at") == []
    assert files() == after


def test_a_partition_load_evaluates_its_rows_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            ran.add(len(batch))
            yield batch

    path = fresh_path(spark, "daily")
    first = spark.createDataFrame([("a", 20240101), ("b", 20240102)], "v string, CurrentDate int")
    sinks.replace_newest_partition(first, path)
    second = spark.createDataFrame([("late", 20240101), ("new", 20240102), ("new", 20240102)], "v string, CurrentDate int")
    sinks.replace_newest_partition(second.mapInPandas(counted, second.schema), path)
    assert ran.value == 3
    assert rows(spark.read.parquet(path)) == [("a", 20240101), ("late", 20240101), ("new", 20240102), ("new", 20240102)]


def test_backfill_key_overwrites_where_matched(spark):
    target = frame(spark, (1, None, 5, "x"), (1, "was", 6, "y"), (2, "stays", 5, "z"))
    source = spark.createDataFrame([(1, 5, "n5"), (1, 6, "n6"), (1, 5, "n9")], "UserID long, Date int, ChatID string")
    done = merge.backfill_key(target, source, ["UserID", "Date"], "ChatID", "ChatID")
    assert rows(done) == [(1, "n5", 5, "x"), (1, "n6", 6, "y"), (2, "stays", 5, "z")]


def test_partition_replacement(spark):
    path = fresh_path(spark, "daily")
    stored = spark.createDataFrame([("a", 1, 20240101), ("b", 1, 20240102)], "k string, v int, TransactionDateID int")
    stored.write.partitionBy("TransactionDateID").parquet(path)
    batch = spark.createDataFrame(
        [("c", 2, 20240102), ("", 3, 20240102), ("d", 4, 20240101)], "k string, v int, CurrentDate int"
    )
    sinks.replace_newest_partition(batch, path)
    found = rows(spark.read.parquet(path))
    assert found == sorted(
        [("a", 1, 20240101), ("d", 4, 20240101), ("c", 2, 20240102), (None, 3, 20240102)], key=repr
    )
    sinks.replace_newest_partition(batch.limit(0), path)
    assert rows(spark.read.parquet(path)) == found


def test_bucketed_target_is_not_shuffled(spark):
    target = frame(spark, *[(n, str(n), 1, "v") for n in range(100)])
    spark.sql("DROP TABLE IF EXISTS bucketed_fact")
    sinks.write_bucketed(target, "bucketed_fact", 8, *KEYS)
    source = frame(spark, *[(n, str(n), 1, "v") for n in range(90, 120)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = merge.rows_to_insert(source, spark.table("bucketed_fact"), KEYS, ["Date"])
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # the batch only: its keys and its rows
        assert new.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE bucketed_fact")


def test_fact_table_types(spark):
    row = ("t", 5, datetime(2024, 1, 1), 3, "r", 1.25, "b", "c", "Support Chat", "77", "A", "h")
    row += (0.125, 0.2, 0.675, "Positive")
    stored = merge.to_fact_table(spark.createDataFrame([row], FACT))
    assert [f.dataType for f in stored.schema] == [f.dataType for f in FACT_TABLE]
    first = stored.first()
    assert str(first.Negative_Score) == "0.13" and first.TransactionDate is not None


def test_audit_row(spark):
    kinds = "Negative double, Neutral double, Positive double"
    scored = spark.createDataFrame([(0.2, 0.3, 0.5), (0.4, 0.3, 0.3)], kinds)
    row = merge.audit_row(scored, "p", "predict", "note").first()
    assert (row.Stat1, row.Stat2, row.Stat3, row.RecordCount, row.Comments) == (0.3, 0.3, 0.4, 2, "note")
    assert merge.audit_row(scored.limit(0), "p", "train").first().RecordCount == 0


def test_null_key_rows_take_no_part_in_the_shuffle(spark):
    source = frame(spark, (None, "a", 1, "x"))
    plan = merge.rows_to_insert(source, frame(spark, (1, "a", 1, "x")), KEYS, ["Date"])
    assert plan.where(F.col("UserID").isNull()).count() == 1


def test_partition_load_survives_a_break(spark, monkeypatch):
    """A load that breaks off before or in its write, tried again under its name, gives what one load gives."""
    schema = "v string, CurrentDate int"
    first = spark.createDataFrame([("a", 20240101), ("b", 20240102), ("", 20240102)], schema)
    second = spark.createDataFrame([("late", 20240101), ("new", 20240102)], schema)

    def lost(self, target, *args, **more):
        raise RuntimeError("lost")

    def load(path, run, *broken):
        for place in broken:
            with monkeypatch.context() as patch, pytest.raises(RuntimeError):
                patch.setattr(DataFrameWriter, "parquet", lost if place == "before" else after(path))
                sinks.replace_newest_partition(second, path, run=run)
        sinks.replace_newest_partition(second, path, run=run)
        return sorted(map(tuple, spark.read.parquet(path).collect()))

    def after(path):
        write = DataFrameWriter.parquet

        def stop(self, target, *args, **more):
            write(self, target, *args, **more)
            if target == path:
                raise RuntimeError("lost")

        return stop

    results = []
    for broken in ((), ("before",), ("after",), ("before", "after")):
        path = fresh_path(spark, "dates")
        sinks.replace_newest_partition(first, path)
        results.append(load(path, f"run-{uuid.uuid4().hex}", *broken))
    assert results[0] == [("a", 20240101), ("late", 20240101), ("new", 20240102)]
    assert all(r == results[0] for r in results)
