from datetime import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from palaver.operators.filters import ChatFilter
from palaver.operators.quality import NullsFound, require_no_nulls
from palaver.plans import jobs
from palaver.schemas import AGENT_COLUMN, CHATS, FACT, PHRASES, PROFILE
from palaver.session import fresh_path
from palaver.sources import files, sample, sinks
from palaver.sources.warehouse import Warehouse, run_query
from palaver.streaming import hourly, loads


def chat(n, text, **fields):
    talk = [
        {"author_name": "Vi", "user_type": "visitor", "date": "2024-01-01 10:00:00", "text": text},
        {"author_name": "Ann", "user_type": "agent", "date": "2024-01-01 10:01", "text": "mail ann@shop.example.org"},
    ]
    base = dict.fromkeys(CHATS.names) | {
        "ID": str(n),
        "UserID": n,
        "Messages": str(talk),
        "rate": "not_rated",
        "duration": 60 * n,
        "started": datetime(2024, 1, n),
        AGENT_COLUMN: "Ann",
    }
    return base | fields


def tables(spark, *chats):
    return (
        spark.createDataFrame(list(chats), CHATS),
        spark.createDataFrame([(1, 4, "B", "EU")], PROFILE),
        spark.createDataFrame([("ok",)], PHRASES),
    )


def test_load_twice(spark):
    stage, facts, audit = (fresh_path(spark, name) for name in ("stage", "facts", "audit"))
    first = tables(spark, chat(1, "good great, call 020 7946 0999"), chat(2, "ok"), chat(3, "worst trash"))
    jobs.run_load(spark, *first, stage, facts, audit, first_load=True, days=None)
    stored = {r.ChatID: r for r in files.read_serving(spark, facts).collect()}
    assert set(stored) == {"1", "3"}  # chat 2 said nothing but a listed phrase
    assert stored["1"].text == "good great, call <PHONE NUMBER>"
    assert stored["1"].html_text.startswith("<b>Vi (visitor) on 2024-01-01 10:00:00</b><br>good great, call <PHONE")
    assert "<EMAIL>" in stored["1"].html_text and "ann@" not in stored["1"].html_text
    assert (stored["1"].Sentiment, stored["3"].Sentiment) == ("Positive", "Negative")
    assert (stored["1"].VIPLevel, stored["3"].VIPLevel, stored["3"].Brand) == (4, 0, "")

    second = tables(spark, chat(1, "changed"), chat(4, "hello"))
    run = jobs.run_load(spark, *second, stage, facts, audit, days=None)
    stored = {r.ChatID: r.text for r in files.read_serving(spark, facts).collect()}
    assert stored == {"1": "good great, call <PHONE NUMBER>", "3": "worst trash", "4": "hello"}
    assert files.latest_run(spark, stage) == run
    assert {r.ChatID for r in files.read_stage(spark, stage).collect()} == {"1", "4"}
    assert sorted(r.RecordCount for r in spark.read.parquet(audit).collect()) == [2, 2]


def test_bucketed_load_shuffles_the_batch_only(spark):
    spark.sql("DROP TABLE IF EXISTS bucketed_facts")
    first, second = (
        jobs.scored_facts(jobs.shaped_chats(*tables(spark, *chats), days=None))
        for chats in ((chat(1, "a"), chat(2, "b")), (chat(2, "changed"), chat(3, "c")))
    )
    try:
        jobs.load_bucketed_facts(first, "bucketed_facts", 4)
        jobs.load_bucketed_facts(second, "bucketed_facts", 4)
        assert {r.ChatID: r.text for r in spark.table("bucketed_facts").collect()} == {"1": "a", "2": "b", "3": "c"}
    finally:
        spark.sql("DROP TABLE bucketed_facts")


def test_null_rating_stops_the_load(spark):
    paths = [fresh_path(spark, name) for name in ("stage", "facts", "audit")]
    with pytest.raises(NullsFound, match="Rating"):
        jobs.run_load(spark, *tables(spark, chat(1, "hi", rate=None)), *paths, first_load=True, days=None)


def test_profile_must_be_unique(spark):
    chats, profile, phrases = tables(spark, chat(1, "hi"))
    paths = [fresh_path(spark, name) for name in ("stage", "facts", "audit")]
    with pytest.raises(ValueError, match="several rows"):
        jobs.run_load(spark, chats, profile.union(profile), phrases, *paths, first_load=True)


def test_windows(spark):
    chats, profile, phrases = tables(spark, chat(1, "a"), chat(9, "b"))
    recent = jobs.shaped_chats(chats, profile, phrases, as_of="2024-01-12 00:00:00")
    assert [r.ID for r in recent.collect()] == ["9"]
    loaded = jobs.scored_facts(jobs.shaped_chats(chats, profile, phrases, days=None)).where("ChatID = '1'")
    later = jobs.shaped_chats(chats, profile, phrases, loaded=loaded)
    assert [r.ID for r in later.collect()] == ["9"]


def test_window_without_and_before_a_first_load(spark):
    chats, profile, phrases = tables(spark, chat(1, "a"), chat(9, "b"))
    nothing = jobs.scored_facts(jobs.shaped_chats(chats, profile, phrases, days=None)).limit(0)
    taken = lambda **window: sorted(r.ID for r in jobs.windowed_chats(chats, **window).collect())
    assert taken(days=None) == ["1", "9"]
    assert taken(days=0, as_of="2024-01-08 12:00:00") == ["9"]
    assert taken(loaded=nothing, as_of="2024-01-25 00:00:00", days=2) == ["1", "9"]
    assert taken(loaded=nothing, as_of="2024-01-25 00:00:00", first_load_days=20) == ["9"]
    fixed = jobs.fixed_window(spark, {"loaded": nothing, "days": None})
    assert fixed["days"] is None and fixed["loaded"].count() == 1 and taken(**fixed) == []


def test_filters_on_other_columns_reach_the_scan_before_the_parse(spark):
    chats, profile, phrases = tables(spark, chat(1, "a"), chat(9, "b"))
    chats.write.parquet(path := fresh_path(spark, "chats"))
    stored = spark.read.schema(CHATS).parquet(path)
    late = F.col("Date") > F.lit("2024-01-05").cast("timestamp_ntz")
    frame = jobs.shaped_chats(stored, profile, phrases, days=None, where=late)
    assert [r.ID for r in frame.collect()] == ["9"]
    plan = spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    assert "GreaterThan(started,2024-01-05" in plan


def test_unreadable_chats_are_set_aside(spark):
    paths = [fresh_path(spark, name) for name in ("stage", "facts", "audit", "quarantine")]
    chats, profile, phrases = tables(spark, chat(1, "a"), chat(2, "b", Messages="[{'text': undefined}]"))
    jobs.run_load(spark, chats, profile, phrases, *paths, first_load=True, days=None)
    assert [r.ChatID for r in files.read_serving(spark, paths[1]).collect()] == ["1"]
    assert [r.ID for r in spark.read.parquet(paths[3]).collect()] == ["2"]


def test_a_load_with_quarantine_parses_once(spark, monkeypatch):
    """Facts and unreadable chats come out of one pass over the chats, and its raw copy does not stay."""
    paths = [fresh_path(spark, name) for name in ("stage", "facts", "audit", "quarantine")]
    chats, profile, phrases = tables(
        spark, chat(1, "a"), chat(2, "b", Messages="[{'text': undefined}]", rate=None), chat(3, "ok"), chat(4, "c", Messages="[{'text': 'cut")
    )
    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            ran.add(len(batch))
            yield batch

    plain = chats.toDF(*(f"c{n}" for n in range(len(CHATS))))  # a name holds dots
    watched = plain.mapInPandas(counted, plain.schema).toDF(*CHATS.names)
    made = []
    monkeypatch.setattr(jobs, "fresh_path", lambda session, name: made.append(fresh_path(session, name)) or made[-1])
    jobs.run_load(spark, watched, profile, phrases, *paths, first_load=True, days=None)
    assert ran.value == 4
    assert [r.ChatID for r in files.read_serving(spark, paths[1]).collect()] == ["1"]
    (lost,) = spark.read.parquet(paths[3]).collect()
    assert (lost.ID, lost.UserID, lost.Messages, lost.started) == ("2", 2, "[{'text': undefined}]", datetime(2024, 1, 2))
    assert made and not any(sinks.exists(spark, path) for path in made)
    assert spark.read.parquet(paths[2]).first().RecordCount == 1


def test_the_stage_is_read_again_by_the_merge_alone(spark, monkeypatch):
    paths = [fresh_path(spark, name) for name in ("stage", "facts", "audit")]
    for name in ("null_census", "require_no_nulls"):
        monkeypatch.setattr(f"palaver.operators.quality.{name}", lambda df: pytest.fail("the stage was read for the gate"))
    jobs.run_load(spark, *tables(spark, chat(1, "good great"), chat(3, "worst trash")), *paths, first_load=True, days=None)
    audit = spark.read.parquet(paths[2]).first()
    facts = spark.read.parquet(paths[1]).agg(F.round(F.avg("Negative"), 6), F.count("*")).first()
    assert (audit.Stat1, audit.RecordCount) == tuple(facts)


def test_chats_stream_into_facts(spark):
    source, table, state = (fresh_path(spark, name) for name in ("source", "facts", "state"))
    first, profile, phrases = tables(spark, chat(1, "good great"), chat(2, "ok"), chat(3, "worst trash"))
    sinks.create_table(spark, f"{table}/batch=-1", FACT)

    def run(chats):
        chats.write.mode("append").parquet(source)
        stream = spark.readStream.schema(CHATS).parquet(source)
        to_facts = jobs.facts_of(profile, phrases)
        loads.stream_merge(stream, to_facts, table, state, check=require_no_nulls).awaitTermination()
        stored = spark.read.schema(FACT).parquet(f"{table}/batch=*")
        return {r.ChatID: r.Sentiment for r in stored.collect()}

    assert run(first) == {"1": "Positive", "3": "Negative"}
    second, _, _ = tables(spark, chat(1, "bad"), chat(4, "hello"))
    assert run(second) == {"1": "Positive", "3": "Negative", "4": "Neutral"}
    with pytest.raises(StreamingQueryException, match="Rating"):
        run(tables(spark, chat(5, "no rating", rate=None))[0])


def test_empty_load(spark):
    paths = [fresh_path(spark, name) for name in ("stage", "facts", "audit")]
    chats, profile, phrases = tables(spark, chat(1, "a"))
    jobs.run_load(spark, chats.limit(0), profile, phrases, *paths, first_load=True)
    assert spark.read.schema(FACT).parquet(paths[1]).count() == 0


def test_dashboard_frames(spark, sf_dir):
    frames = jobs.serve_dashboard(sample.fact(spark, sf_dir), ChatFilter(chat_types=["Support Chat"]))
    series = {f"vip_{s}" for s in ("negative", "neutral", "positive")}
    assert set(frames) == {"hourly", "vip_sentiment", "density"} | series
    facts = sample.fact(spark, sf_dir).where("ChatType = 'Support Chat'")
    totals = {r.chart: r.n for r in frames["hourly"].groupBy("chart").agg(F.sum("chats").alias("n")).collect()}
    assert totals == dict.fromkeys(("per_hour", "hour_sentiment", "hour_country"), facts.count())
    assert sum(frames[s].agg(F.sum("chats")).first()[0] for s in series) == facts.count()
    assert frames["hourly"]._jdf.queryExecution().optimizedPlan().toString().count("events") <= 1 + facts._jdf.queryExecution().optimizedPlan().toString().count("events")


def test_filters_reach_the_scan(spark, sf_dir):
    path = fresh_path(spark, "serving")
    sinks.write_serving(sample.fact(spark, sf_dir), path)
    chosen = ChatFilter(date=("2024-01-03", None), vip=(1, 3), sentiments=["Negative"])
    frame = jobs.serve_dashboard(spark.read.parquet(path), chosen)["hourly"]
    plan = spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    expected = ("GreaterThanOrEqual(Date,2024-01-03", "GreaterThanOrEqual(VIPLevel,1)", "(VIPLevel,3)", "(Sentiment,Neg")
    assert all(part in pushed for part in expected)
    assert plan.count("ReadSchema") == 1  # one scan for three charts
    assert "ReadSchema: struct<Date:timestamp_ntz,VIPLevel:int,CountryGroup1:string,Sentiment:string>" in plan


def test_csv_sources(spark, tmp_path):
    listed = tmp_path / "phrases.csv"
    listed.write_text('FilterMessages\nok\n"No, I have questions"\nいいえ\nBono de Verificación\n', encoding="utf-8")
    found = {r.FilterMessages for r in files.read_phrases(spark, str(listed)).collect()}
    assert found == {"ok", "No, I have questions", "いいえ", "Bono de Verificación"}
    rows = spark.createDataFrame([("a\nb", ""), ('say "x", y', None)], "a string, b string")
    path = fresh_path(spark, "csv")
    sinks.write_csv(rows, path)
    assert {tuple(r) for r in files.read_chat_export(spark, path, rows.schema).collect()} == {
        ("a\nb", ""),
        ('say "x", y', None),
    }


def test_tables_are_created_and_emptied(spark):
    path = fresh_path(spark, "table")
    sinks.create_table(spark, path, FACT)
    assert spark.read.schema(FACT).parquet(path).count() == 0
    sinks.append(spark.createDataFrame([tuple([None] * len(FACT))], FACT), path)
    assert files.read_table(spark, path, FACT).count() == 1
    sinks.create_table(spark, path, FACT)
    assert spark.read.schema(FACT).parquet(path).count() == 0


def test_missing_stage(spark):
    with pytest.raises(FileNotFoundError):
        files.read_stage(spark, fresh_path(spark, "stage"))


def test_warehouse_options():
    house = Warehouse("jdbc:example://host/db", user="u", password="p")
    assert "password='p'" not in repr(house)
    options = house.table_options("dbo.chats", column="UserID", lower=1, upper=9, partitions=4)
    assert options["partitionColumn"] == "UserID" and options["numPartitions"] == "4"
    assert house.append_options("t")["batchsize"] == "1000"
    assert house.query_options("SELECT 1")["query"] == "SELECT 1"
    with pytest.raises(ValueError):
        house.table_options("t", column="UserID")


def test_run_query(spark):
    assert run_query(spark, "SELECT 1 AS one").first().one == 1


def events(spark, path, *rows):
    spark.createDataFrame(list(rows), sample.TABLES["events"]).coalesce(1).write.mode("append").parquet(path)


def event(n, user=1):
    return (n, datetime(2024, 1, 1, n % 24, 10), user, "view", 1.0, '{"k": 10}')


def test_stream_merge_over_several_runs(spark):
    source, table, state = (fresh_path(spark, name) for name in ("source", "facts", "state"))
    profile = spark.createDataFrame([(1, 4, "B", "EU")], PROFILE)
    events(spark, source, event(0), event(1), event(2, None))
    facts = sample.fact_of(sample.chats_of(spark.read.parquet(source)), profile)
    sinks.write_batch(facts.where("ChatID = '0'"), table, -1)

    def run():
        stream = spark.readStream.schema(sample.TABLES["events"]).parquet(source)
        loads.stream_merge(
            sample.chats_of(stream), lambda rows: sample.fact_of(rows, profile), table, state
        ).awaitTermination()
        return sorted(r.ChatID for r in spark.read.parquet(table).collect())

    assert run() == ["0", "1", "2"]
    events(spark, source, event(1), event(3), event(2, None))
    assert run() == ["0", "1", "2", "2", "3"]  # the null key is inserted each time
    assert run() == ["0", "1", "2", "2", "3"]


def test_hourly_counts_follow_new_chats(spark):
    source, table, state = (fresh_path(spark, name) for name in ("source", "counts", "state"))
    profile = spark.createDataFrame([(1, 4, "B", "EU")], PROFILE)
    events(spark, source, event(1), event(2), event(2))

    def run():
        stream = spark.readStream.schema(sample.TABLES["events"]).parquet(source)
        facts = sample.fact_of(sample.chats_of(stream), profile)
        hourly.start_hourly_counts(facts, table, state).awaitTermination()
        return {r.Date.hour: r.chats for r in hourly.read_hourly_counts(spark, table).collect()}

    assert run() == {1: 1, 2: 2}
    events(spark, source, event(2), event(3))
    assert run() == {1: 1, 2: 3, 3: 1}
    events(spark, source, event(23))
    assert run() == {1: 1, 2: 3, 3: 1, 23: 1}
    events(spark, source, event(1))  # very late, in an hour that was counted
    assert run() == {1: 2, 2: 3, 3: 1, 23: 1}
    hourly.compact_hourly_counts(spark, table, compacted := fresh_path(spark, "counts"))
    assert {r.Date.hour: r.chats for r in hourly.read_hourly_counts(spark, compacted).collect()} == {1: 2, 2: 3, 3: 1, 23: 1}
