"""The clustered layout: the curve, the buckets, and how many rows a scan reads under one filter or another."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palaver.operators.filters import ChatFilter
from palaver.session import fresh_path
from palaver.sources import clustered
from test_filters import fact


def rows_scanned(df):
    """What the scans of a query gave out: whole row groups, before the filter."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        query = df._jdf.queryExecution()
        plan = query.executedPlan()
        df._jdf.sparkSession().sharedState()
        plan.executeCollectPublic()
        leaves = plan.collectLeaves()
        return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def table(spark, n=40_000):
    value = F.xxhash64("id")
    return spark.range(n).select(
        F.col("id").cast("string").alias("ChatID"),
        (F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("Date"),
        F.pmod(value, F.lit(8)).cast("int").alias("VIPLevel"),
        F.concat(F.lit("brand "), F.pmod(F.shiftright(value, 8), F.lit(6)).cast("string")).alias("Brand"),
        F.when(F.pmod(F.shiftright(value, 16), F.lit(3)) > 0, F.concat(F.lit("C"), F.pmod(F.shiftright(value, 24), F.lit(5)).cast("string"))).alias(
            "CountryGroup1"
        ),
    )


def test_interleaving_takes_bits_in_turn(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(16), rng.randrange(16), rng.randrange(16)) for _ in range(50)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    got = df.select("a", "b", "c", clustered.interleaved([F.col("a"), F.col("b"), F.col("c")], 4).alias("z")).collect()
    for r in got:
        bits = [(value >> bit & 1) << bit * 3 + n for bit in range(4) for n, value in enumerate((r.a, r.b, r.c))]
        assert r.z == sum(bits)


def test_ordinals_keep_the_order(spark):
    moments = [datetime(1969, 12, 31, 23), datetime(1970, 1, 1), datetime(2024, 2, 29, 12), datetime(2024, 2, 29, 13)]
    df = spark.createDataFrame([(m, m.date(), n) for n, m in enumerate(moments)], "t timestamp_ntz, d date, n int")
    for name in df.columns:
        got = [r.v for r in df.orderBy("n").select(clustered.ordinal(F.col(name), df.schema[name].dataType).alias("v")).collect()]
        assert got == sorted(got) and len(set(got)) >= 3


def test_buckets_of_texts(spark):
    texts = ["", "a", "ab", "abc", "b", "zürich", "é", "日本", "abcdefgh"] * 3 + ["hot"] * 40
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "v string")
    edges = clustered.text_edges(df, "v", 64)
    assert edges == sorted({*texts} - {""}, key=str.encode)  # a bucket for each value
    got = {r.v: r.b for r in df.select("v", clustered.bucket_of(F.col("v"), edges).alias("b")).collect() if r.v is not None}
    assert [got[t] for t in sorted(got, key=str.encode)] == list(range(10))
    many = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("v"))
    edges = clustered.text_edges(many, "v", 16)
    sizes = [r["count"] for r in many.groupBy(clustered.bucket_of(F.col("v"), edges)).count().collect()]
    assert len(edges) == 15 and edges == sorted(edges) and 700 < min(sizes) <= max(sizes) < 2000


def test_a_load_keeps_its_rows(spark):
    path, facts = fresh_path(spark, "clustered"), table(spark, 500)
    clustered.write_clustered(facts.where("VIPLevel < 4"), path, rows_per_file=50)
    clustered.write_clustered(facts.where("VIPLevel >= 4"), path, rows_per_file=50)
    stored = clustered.read_clustered(spark, path, facts.schema)
    assert sorted(map(tuple, stored.collect()), key=repr) == sorted(map(tuple, facts.collect()), key=repr)


def test_odd_rows_are_kept(spark):
    rows = fact(spark, {"Brand": None, "VIPLevel": None, "Date": None}, {"Brand": ""}, {}, {}, {"Date": datetime(1900, 1, 1) + timedelta(seconds=1)})
    path = fresh_path(spark, "clustered")
    clustered.write_clustered(rows, path)
    clustered.write_clustered(rows.limit(0), path)
    stored = clustered.read_clustered(spark, path, rows.schema)
    assert sorted(map(tuple, stored.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    with pytest.raises(ValueError):
        clustered.with_curve_place(rows, ["Date"] * 8, 8)


def test_every_filter_reads_fewer_row_groups_than_by_date(spark):
    facts = table(spark)
    curve, dated = fresh_path(spark, "clustered"), fresh_path(spark, "dated")
    clustered.write_clustered(facts, curve, rows_per_file=500)
    facts.repartitionByRange(80, "Date").sortWithinPartitions("Date").write.parquet(dated)
    total = facts.count()
    mixes = {
        "vip": ChatFilter(vip=(7, None)),
        "brand": ChatFilter(brands=["brand 0"]),
        "country": ChatFilter(countries=["C1"]),
        "all": ChatFilter(date=("2024-01-05", "2024-01-12"), vip=(2, 3), brands=["brand 2"]),
    }
    for name, chosen in mixes.items():
        left = clustered.read_clustered(spark, curve, facts.schema, chosen)
        read = rows_scanned(left)
        assert read < (0.2 if name == "all" else 0.75) * total, name
        assert read < rows_scanned(chosen.apply(spark.read.schema(facts.schema).parquet(dated))), name
        assert left.count() == chosen.apply(facts).count()
    week = ChatFilter(date=("2024-01-05", "2024-01-07"), end_inclusive_day=True)
    left = clustered.read_clustered(spark, curve, facts.schema, week)
    assert rows_scanned(left) < total / 2 and left.columns == facts.columns
    assert sorted(left.select("ChatID").collect()) == sorted(week.apply(facts).select("ChatID").collect())
