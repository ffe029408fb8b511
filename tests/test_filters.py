from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palaver.operators import extract
from palaver.operators.dashboard import bounds, count_by, options, vip_pivot
from palaver.operators.filters import ChatFilter, trailing_range
from palaver.operators.search import as_field_rows, chat_details, display_names, hit_count, search_results
from palaver.schemas import AGENT_COLUMN, CHATS, DISPLAY_NAMES, FACT, PROFILE
from palaver.sources import sample


def fact(spark, *rows):
    base = {
        "text": "t",
        "UserID": 1,
        "Date": datetime(2024, 1, 1),
        "VIPLevel": 1,
        "Rating": "r",
        "DurationInMins": 1.0,
        "Brand": "B",
        "CountryGroup1": "C",
        "ChatType": "Support Chat",
        "ChatID": "1",
        "AgentDisplayName": "A",
        "html_text": "<b>Al</b>",
        "Negative": 0.1,
        "Neutral": 0.2,
        "Positive": 0.7,
        "Sentiment": "Positive",
    }
    return spark.createDataFrame([base | {"ChatID": str(n)} | row for n, row in enumerate(rows)], FACT)


def ids(df):
    return sorted(r.ChatID for r in df.collect())


def test_date_bounds_are_moments_unless_asked(spark):
    df = fact(spark, {"Date": datetime(2024, 1, 2)}, {"Date": datetime(2024, 1, 2, 9)}, {"Date": datetime(2024, 1, 3)})
    assert ids(ChatFilter(date=("2024-01-01", "2024-01-02")).apply(df)) == ["0"]
    assert ids(ChatFilter(date=("2024-01-01", "2024-01-02"), end_inclusive_day=True).apply(df)) == ["0", "1"]


def test_all_entry_and_empty_choice_do_not_filter(spark):
    df = fact(spark, {"Brand": "X"}, {"Brand": "Y"})
    assert ids(ChatFilter(brands=["X"]).apply(df)) == ["0"]
    assert ids(ChatFilter(brands=["X", "All Brands"]).apply(df)) == ["0", "1"]
    assert ids(ChatFilter(brands=[], sentiments=()).apply(df)) == ["0", "1"]


def test_duration_bound_cut_to_int_loses_the_longest(spark):
    df = fact(spark, {"DurationInMins": 93.4}, {"DurationInMins": 93.0})
    limits = bounds(df).first()
    assert (limits.durationinmin_min, limits.durationinmin_max) == (93, 93)
    assert limits.date_max == datetime(2024, 1, 2)
    assert ids(ChatFilter(duration=(limits.durationinmin_min, limits.durationinmin_max)).apply(df)) == ["1"]


def test_search_is_a_case_sensitive_regex_over_html(spark):
    df = fact(spark, {"html_text": "Hello you"}, {"html_text": "hello"}, {"html_text": "Britain"})
    chosen = ChatFilter(search="Hello|Britain")
    assert ids(chosen.apply(df)) == ["0", "2"]
    assert hit_count(df, chosen).first().hits == 2
    assert ids(ChatFilter(search="^t$", search_column="text").apply(df)) == ["0", "1", "2"]


def test_search_results_shape(spark):
    df = fact(spark, {"DurationInMins": 2.5, "text": "y" * 150}, {"Date": datetime(2023, 1, 1)})
    rows = search_results(df, ChatFilter(), 1).collect()
    assert len(rows) == 1 and rows[0]["Chat ID"] == "1"  # the earlier chat
    shown = search_results(df, ChatFilter(), 5)
    assert shown.columns == [
        DISPLAY_NAMES[c] for c in FACT.names if c not in ("html_text", "Rating", "Negative", "Neutral", "Positive")
    ]
    assert {r["Duration (Mins)"] for r in shown.collect()} == {2.0, 1.0}
    assert {r["Text"] for r in shown.collect()} == {"y" * 100 + "...", "t..."}


def test_details(spark):
    df = fact(spark, {}, {"ChatType": "Chatbot Chat"})
    rows = {r.field: r.value for r in as_field_rows(chat_details(df, "1")).collect()}
    assert rows["Chat Type"] == "Chatbot Chat" and rows["Positive Score"] == "0.7" and "Text" not in rows
    assert ids(chat_details(df, "", seed="any")) == ["0"]  # only support chats are picked
    assert display_names(df).columns[1] == "User ID" or "User ID" in display_names(df).columns


def test_range_presets(spark):
    df = fact(spark, {"Date": datetime(2024, 3, 31)}, {"Date": datetime(2024, 2, 29)}, {"Date": datetime(2023, 12, 31)})
    assert ids(trailing_range(df, "7d")) == ["0"]
    assert ids(trailing_range(df, "1m")) == ["0", "1"]
    assert ids(trailing_range(df, "ytd")) == ["0", "1"]
    assert ids(trailing_range(df, "6m")) == ["0", "1", "2"]
    assert ids(trailing_range(df, "all")) == ["0", "1", "2"]


def test_null_keys_are_not_counted(spark):
    df = fact(spark, {"Brand": None}, {"Brand": "X"}, {"Brand": "X"})
    assert [tuple(r) for r in count_by(df, "Brand").collect()] == [("X", 2)]
    assert [r.value for r in options(df, {"Brand": "All Brands"}).collect()] == ["All Brands", "X"]


def test_pivot_fills_missing_with_zero(spark):
    row = vip_pivot(fact(spark, {}, {})).first()
    assert row.asDict() == {"VIPLevel": 1, "Negative": 0, "Neutral": 0, "Positive": 2}


def chats(spark, *rows):
    base = dict.fromkeys(CHATS.names) | {"ID": "1", "UserID": 1, "duration": 90, "started": datetime(2024, 1, 1)}
    return spark.createDataFrame([base | r for r in rows], CHATS)


def profile(spark, *rows):
    return spark.createDataFrame(list(rows), PROFILE)


def test_join_keeps_chats_without_profile(spark):
    rows = chats(
        spark,
        {"ID": "a", "tags": "x,ChatBot", AGENT_COLUMN: "Ann"},
        {"ID": "b", "UserID": 2},
        {"ID": "c", "UserID": None},
        {"ID": None},
    )
    joined = extract.chats_with_profile(rows, profile(spark, (1, 3, "B", "C")))
    found = {r.ID: (r.VIPLevel, r.ChatType, r.AgentDisplayName, r.DurationInMins) for r in joined.collect()}
    assert found == {
        "a": (3, "Chatbot Chat", "Ann", 1.5),
        "b": (None, "Support Chat", None, 1.5),
        "c": (None, "Support Chat", None, 1.5),
    }


def test_repeated_profile_rows_repeat_chats(spark):
    joined = extract.chats_with_profile(chats(spark, {}), profile(spark, (1, 3, "B", "C"), (1, 4, "B", "C")))
    assert joined.count() == 2


def test_incremental_modes(spark):
    loaded = fact(spark, {"Date": datetime(2024, 1, 5, 12)})
    rows = chats(
        spark,
        {"ID": "early", "started": datetime(2024, 1, 5, 11)},
        {"ID": "same day", "started": datetime(2024, 1, 5, 18)},
        {"ID": "next", "started": datetime(2024, 1, 6)},
    )
    by = {m: sorted(r.ID for r in extract.not_yet_loaded(rows, loaded, mode=m).collect()) for m in ("day", "timestamp")}
    assert by == {"day": ["next"], "timestamp": ["next", "same day"]}
    first = extract.not_yet_loaded(rows, loaded.limit(0), "2024-02-04 18:00:00", days=30)
    assert [r.ID for r in first.collect()] == ["next"]
    with pytest.raises(ValueError):
        extract.not_yet_loaded(rows, loaded, mode="week")


def test_new_users_and_window(spark):
    rows = chats(spark, {"ID": "a", "UserID": 7}, {"ID": "b"}, {"ID": "c", "UserID": None})
    assert sorted(r.ID for r in extract.new_users(rows, fact(spark, {})).collect()) == ["a", "c"]
    assert extract.started_within(rows, "2024-01-11 00:00:00").count() == 0  # strictly later
    assert extract.started_within(rows, F.lit("2024-01-10 23:59:59").cast("timestamp_ntz")).count() == 3


def test_newest_loaded_is_pushed_to_the_scan(spark, sf_dir):
    rows = extract.not_yet_loaded(sample.chats(spark, sf_dir), fact(spark, {}), "2024-01-31 00:00:00")
    plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    assert "GreaterThan(ts,ScalarSubquery" in plan
