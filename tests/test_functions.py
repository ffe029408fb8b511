from datetime import datetime, timedelta

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palaver.functions import numbers, scores, text, times

NTZ = "t timestamp_ntz"


def rounded(spark, moments):
    frame = spark.createDataFrame([(m,) for m in moments], NTZ)
    return [r[0] for r in frame.select(times.round_hour(F.col("t"))).collect()]


def test_half_hours_go_to_the_even_hour(spark):
    us = timedelta(microseconds=1)
    even, odd, last = datetime(2024, 1, 1, 0, 30), datetime(2024, 1, 1, 1, 30), datetime(2024, 1, 1, 23, 30)
    moments = [even, odd, last, even - us, even + us, odd - us, datetime(2024, 1, 1, 5)]
    assert rounded(spark, moments) == [
        datetime(2024, 1, 1, 0),
        datetime(2024, 1, 1, 2),
        datetime(2024, 1, 2, 0),
        datetime(2024, 1, 1, 0),
        datetime(2024, 1, 1, 1),
        datetime(2024, 1, 1, 1),
        datetime(2024, 1, 1, 5),
    ]


moment = st.datetimes(datetime(1970, 1, 1), datetime(2100, 1, 1))
half = st.builds(lambda m: m.replace(minute=30, second=0, microsecond=0), moment)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(moment, half), min_size=50, max_size=200))
def test_round_hour_is_pandas_round(spark, moments):
    assert rounded(spark, moments) == pd.Series(moments).dt.round("h").tolist()


@pytest.mark.parametrize("zone", ["Asia/Kolkata", "America/New_York"])
def test_round_hour_ignores_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        moments = [datetime(2024, 3, 10, 2, 20), datetime(2024, 3, 10, 2, 40)]
        assert rounded(spark, moments) == [datetime(2024, 3, 10, 2), datetime(2024, 3, 10, 3)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_midnight_after_is_strict(spark):
    frame = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 1, 12),)], NTZ)
    assert [r[0] for r in frame.select(times.midnight_after(F.col("t"))).collect()] == [datetime(2024, 1, 2)] * 2


def test_run_stamp(spark):
    stamp = spark.range(1).select(times.run_stamp()).first()[0]
    datetime.strptime(stamp, "%Y%m%d_%H_%M_%S")


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def test_half_even_minutes(spark):
    for value, expected in ((0.5, 0.0), (1.5, 2.0), (2.5, 2.0), (2.6, 3.0)):
        assert one(spark, value, "double", numbers.half_even) == expected


def test_minutes(spark):
    assert one(spark, 100, "long", numbers.minutes) == 100 / 60
    assert one(spark, 100, "long", lambda c: numbers.minutes(c, integer=True)) == 1
    assert one(spark, -100, "long", lambda c: numbers.minutes(c, integer=True)) == -1


def test_number_repairs(spark):
    nan, inf = float("nan"), float("inf")
    assert one(spark, inf, "double", lambda c: F.isnan(numbers.inf_to_nan(c))) is True
    assert one(spark, nan, "double", numbers.nan_to_number) == 0.0
    assert one(spark, -inf, "double", numbers.nan_to_number) == -numbers.LARGEST_DOUBLE
    assert one(spark, 2.0, "double", numbers.nan_to_number) == 2.0
    for gap in (nan, inf, -inf, None):
        assert one(spark, gap, "double", numbers.fill_gaps) == 999.0
    assert [one(spark, v, "double", numbers.is_finite) for v in (nan, inf, None, 1.0)] == [False, False, False, True]


def test_masks(spark):
    raw = "mail a.b+c@mail.example.org, call +44 (0)20-7946 0999, see https://x.example/a?b=1 or www.y.example now"
    assert one(spark, raw, "string", text.mask_pii) == "mail <EMAIL>, call <PHONE NUMBER>, see <URL> or <URL> now"
    assert one(spark, None, "string", text.mask_pii) is None
    assert one(spark, "no 12345 data @ all", "string", text.mask_pii) == "no 12345 data @ all"


def message(spark, **fields):
    full = {"author_name": None, "user_type": None, "date": None, "text": None} | fields
    frame = spark.createDataFrame([full], "author_name string, user_type string, date string, text string")
    return frame.select(F.struct("*").alias("m"))


def test_header_date_survives_masking(spark):
    frame = message(spark, author_name="Al", user_type="agent", date="2024-01-01 10:20:30", text="ring 020 7946 0999")
    html = frame.select(text.html_message(F.col("m"), mask=True)).first()[0]
    assert html == "<b>Al (agent) on 2024-01-01 10:20:30</b><br>ring <PHONE NUMBER><br><br>"


def test_html_is_escaped_only_on_request(spark):
    frame = message(spark, author_name="A&B", user_type="visitor", date="d", text="<i>")
    html = frame.select(text.html_message(F.col("m")), text.html_message(F.col("m"), escape=True)).first()
    assert html[0] == "<b>A&B (visitor) on d</b><br><i><br><br>"
    assert html[1] == "<b>A&amp;B (visitor) on d</b><br>&lt;i&gt;<br><br>"


def test_null_parts_count_as_empty(spark):
    assert message(spark).select(text.html_message(F.col("m"))).first()[0] == "<b> () on </b><br><br><br>"


def test_tokens(spark):
    raw = "@ann hi @ @bob  http://x y@z httpsome\n@c"
    expected = " ".join(
        "@user" if t.startswith("@") and len(t) > 1 else "http" if t.startswith("http") else t for t in raw.split(" ")
    )
    assert one(spark, raw, "string", text.normalise_tokens).split(" ")[:7] == expected.split(" ")[:7]


def test_preview_always_ends_in_dots(spark):
    assert one(spark, "ab", "string", text.preview) == "ab..."
    assert one(spark, "x" * 300, "string", text.preview) == "x" * 100 + "..."


def test_softmax_argmax_labels(spark):
    frame = spark.createDataFrame([([1000.0, 1001.0, 999.0],)], "v array<double>")
    by_array = frame.select(scores.softmax_array(F.col("v"))).first()[0]
    by_column = frame.select(F.array(*scores.softmax([F.col("v")[i] for i in range(3)]))).first()[0]
    assert by_array == pytest.approx(by_column) and sum(by_array) == pytest.approx(1)
    assert one(spark, [0.4, 0.4, 0.2], "array<double>", scores.argmax) == 0
    assert one(spark, [0.2, 0.4, 0.4], "array<double>", scores.best_label) == "Neutral"
    assert [one(spark, i, "int", scores.label_of) for i in (-1, 0, 2, 3)] == ["", "Negative", "Positive", ""]
    assert one(spark, [0.2, 0.3, 0.5], "array<double>", scores.score_map)["Positive"] == 0.5


def test_ranked_keeps_class_order_on_ties(spark):
    frame = spark.createDataFrame([(0.25, 0.5, 0.25)], "a double, b double, c double")
    entries = frame.select(scores.ranked([F.col("a"), F.col("b"), F.col("c")])).first()[0]
    assert [(e["label"], e["score"]) for e in entries] == [("Neutral", 0.5), ("Negative", 0.25), ("Positive", 0.25)]


def test_very_positive(spark):
    rows = [("Positive", 0.8), ("Positive", 0.79), ("Neutral", 0.9), (None, 0.9)]
    frame = spark.createDataFrame(rows, "s string, p double")
    flags = [r[0] for r in frame.select(scores.very_positive(F.col("s"), F.col("p"))).collect()]
    assert flags == [True, False, False, False]
