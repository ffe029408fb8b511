import json
import subprocess
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from palaver.operators import transcripts as tr
from palaver.plans import catalog


def chats(spark, *transcripts):
    return spark.createDataFrame([(str(n), m) for n, m in enumerate(transcripts)], "ID string, Messages string")


def msg(text, kind="visitor", author="Al", date="2024-01-01 10:00"):
    return {"author_name": author, "user_type": kind, "date": date, "text": text}


def test_only_complete_transcripts_stay(spark):
    rows = chats(spark, str([msg("a")]), str([msg("a")])[:-5], "[]", None)
    assert [r.ID for r in tr.complete_transcripts(rows).collect()] == ["0"]


LITERALS = [
    str([msg("plain")]),
    json.dumps([msg("as json")]),
    str([msg(None)]),
    "[{'text': 'flag', 'user_type': 'visitor', 'bot': True}]",
    r"[{'text': 'caf\xe9', 'user_type': 'visitor'}]",
    '[{"text": "it\'s", "user_type": "visitor"}]',
    str([msg('he said "no"\nand left')]),
    "[{'text': 'broken', }}]",
    "[{'text': undefined}]",
]


def test_literal_dialects(spark):
    parsed = tr.parse_transcripts(chats(spark, *LITERALS))
    good, bad = tr.parsed_and_quarantined(parsed)
    texts = {r.ID: r.transcript[0].text for r in good.collect()}
    assert texts == {
        "0": "plain",
        "1": "as json",
        "2": None,
        "3": "flag",
        "4": "café",
        "5": "it's",
        "6": 'he said "no"\nand left',
    }
    assert {r.ID for r in bad.collect()} == {"7", "8"}


@pytest.mark.parametrize("dialect", ["json", "native"])
def test_native_dialects_need_no_python(spark, dialect):
    parsed = tr.parse_transcripts(chats(spark, json.dumps([msg("a")])), dialect=dialect)
    assert parsed.first().transcript[0].text == "a"
    assert "Python" not in parsed._jdf.queryExecution().toString()


HARD = [
    "it's", 'he said "no"', "'\"'\"", "back\\slash", "\\", "\\'", "\\\\\"", "tab\tend", "line\nbreak\r\n", "caf\xe9 \x7f\x80\xa0", "\x00\x01\x1f",
    "None", "True, False", "[{'text': None}]", "}, {", "😀 日本語", "\u2028\u200b", "\\x41 \\u0041 \\n", "a" * 5000, "'" * 3000, "", " ", "\x07\x0b\x08\x0c", "$1 \\1",
]


def messages(row):
    return None if row is None else [None if m is None else m.asDict() for m in row]


def test_the_lexer_reads_what_python_writes(spark):
    """Every text, as `repr` writes it, comes back without Python; so do constants and whole numbers."""
    talks = [[msg(t), msg(None), {"text": t, "agent_id": 17, "date": True, "extra": -5, "user_type": False}] for t in HARD]
    talks += [[], [{}], [None, msg("x")], [msg(t) for t in HARD] * 20]
    rows = chats(spark, *[repr(t) for t in talks])
    native = {r.ID: messages(r.transcript) for r in tr.parse_transcripts(rows, dialect="native").collect()}
    assert native == {str(n): tr._read_literal(repr(t)) for n, t in enumerate(talks)}
    complete = [t for t in talks if repr(t).endswith("}]")]
    assert [tuple(r) for r in tr.literal_census(rows).collect()] == [("native", len(complete))]


ODD = [
    "[{'text': 'a' 'b'}]", "[{'text': ('a', 'b')}]", "[{'text': 1.50}]", "[{'text': -0}]", "[{'text': 1e3}]", "[{'text': 0x1f}]", "[{'text': 1_000}]",
    "[{'text': {'deep': 1}}]", "[{'text': ['x']}]", "[{'text': 'x',}]", "[{'text': b'x'}]", "[{'text': u'x'}]", "[{'text': r'x\\n'}]", "[{1: 'x'}]",
    "[{'text': '\\101'}]", "[{'text': '\\N{BULLET}'}]", "[{'text': '\\U0001F600'}]", "[{'text': 'raw\ttab'}]", "[{'text': 'raw\nbreak'}]",
    "{'text': 'no list'}", "[{'text': 'open}]", "[{'text': 'a'} {'text': 'b'}]", "[{'text': 'mark \ue001'}]", "[{'text': true}]", "[{'text': '\\q'}]",
    "[{'text': 'a'}, 'b']", "[[{'text': 'a'}]]", "'[{}]'", "[{'text': None None}]", "[{'text': 'a', 'text': 'b'}]", "[{'text': NoneTrue}]",
]


def test_what_the_lexer_leaves_goes_to_python(spark):
    rows = chats(spark, *ODD)
    auto = {r.ID: messages(r.transcript) for r in tr.parse_transcripts(rows).collect()}
    expected = {str(n): tr._read_literal(text) for n, text in enumerate(ODD)}
    # JSON, but for its single quotes: read as such, before Python is asked
    lenient = {str(n) for n, text in enumerate(ODD) if "true" in text or "deep" in text or text[0] == "{"}
    assert {k: v for k, v in auto.items() if k not in lenient} == {k: v for k, v in expected.items() if k not in lenient}
    native = {r.ID: messages(r.transcript) for r in tr.parse_transcripts(rows, dialect="native").collect()}
    assert all(v is None or v == auto[k] for k, v in native.items())
    counts = {r.read: r.transcripts for r in tr.literal_census(rows).collect()}
    assert counts["python"] > 5 and counts["unreadable"] > 3 and counts["native"] > 1


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), max_size=4), min_size=1, max_size=60))
def test_the_lexer_agrees_with_python_on_any_text(spark, talks):
    literals = [repr([msg(t) for t in talk]) for talk in talks]
    native = {r.ID: messages(r.transcript) for r in tr.parse_transcripts(chats(spark, *literals), dialect="native").collect()}
    for n, literal in enumerate(literals):
        odd = "\\U" in literal or any(c in literal for c in "\ue000\ue001\ue002")
        assert native[str(n)] == tr._read_literal(literal) or (odd and native[str(n)] is None)


def test_parsed_column_may_not_shadow_the_source(spark):
    with pytest.raises(ValueError):
        tr.parse_transcripts(chats(spark, "[]"), into="messages")


@pytest.mark.parametrize("dialect", ["auto", "json", "native"])
def test_parsing_happens_once(spark, dialect):
    rows = chats(spark, json.dumps([msg("a")]))
    phrases = spark.createDataFrame([("b",)], "FilterMessages string")
    plan = tr.shape_chats(rows, phrases, dialect=dialect)._jdf.queryExecution().executedPlan().toString()
    native = [line for line in plan.splitlines() if "from_json" in line]
    assert len(native) == 1 and "Filter" not in native[0] and native[0].count("from_json") == 1
    assert sum("regexp_extract_all" in line for line in plan.splitlines()) == (0 if dialect == "json" else 1)
    assert "Exchange" not in plan


def test_explode_keeps_order_and_key(spark):
    parsed = tr.parse_transcripts(chats(spark, str([msg("a"), msg("b", "agent")]), str([msg("c")])))
    rows = [(r.Key, r.pos, r.text, r.user_type) for r in tr.explode_messages(parsed).orderBy("Key", "pos").collect()]
    assert rows == [("0", 0, "a", "visitor"), ("0", 1, "b", "agent"), ("1", 0, "c", "visitor")]


PHRASES = ["ok", "No, I have questions", "いいえ", None]
TALKS = [
    [msg("ok"), msg("OK"), msg("ok "), msg("help me"), msg("hello", "agent")],
    [msg("ok"), msg("No, I have questions"), msg("いいえ")],
    [msg(None), msg("x")],
    [msg("only the agent", "agent")],
]


def shaped(spark, phrases, **options):
    rows = chats(spark, *[str(t) for t in TALKS])
    listed = spark.createDataFrame([(p,) for p in phrases], "FilterMessages string")
    return {r.ID: (r.text, r.html_text) for r in tr.shape_chats(rows, listed, **options).collect()}


def test_phrases_match_exactly_and_empty_chats_vanish(spark):
    result = shaped(spark, PHRASES)
    assert {key: text for key, (text, _) in result.items()} == {"0": "OK,ok ,help me", "2": ",x"}
    assert result["2"][1].startswith("<b>Al (visitor) on 2024-01-01 10:00</b><br><br><br>")


def test_long_phrase_lists_give_the_same(spark):
    inline = shaped(spark, PHRASES)
    assert shaped(spark, PHRASES, most_inline=2) == inline


def test_phrases_with_long_texts_are_not_inlined(spark):
    frame = spark.createDataFrame([("x" * 5000,), ("y",)], "FilterMessages string")
    assert tr.inline_phrases(frame) is None


@pytest.mark.parametrize("talks", [20, 600])
def test_visitor_text_drops_the_phrases_of_lists_of_any_length(spark, tmp_path, talks):
    """Ten short messages a chat, all on the list; the even chats end with a long one. 6,000 phrases exceed the bound."""
    long = F.concat(F.lit("x" * 50), F.col("conv_id").cast("string"))
    turns = spark.range(talks * 11).select(F.floor(F.col("id") / 11).alias("conv_id"), (F.col("id") % 11).alias("turn"), "id")
    said = F.when(F.col("turn") < 10, F.concat(F.lit("short "), F.col("id").cast("string"))).otherwise(long)
    role = F.when((F.col("turn") == 10) & (F.col("conv_id") % 2 == 1), "assistant").otherwise("user")
    turns.select("conv_id", "turn", role.alias("role"), said.alias("text")).write.parquet(f"{tmp_path}/conversations.parquet")
    found = catalog.visitor_text(spark, str(tmp_path))
    assert found.columns == ["Key", "text"]
    assert sorted(map(tuple, found.collect())) == sorted((str(n), "x" * 50 + str(n)) for n in range(0, talks, 2))


def test_a_list_too_long_to_inline_is_no_empty_list(spark):
    with pytest.raises(TypeError):
        tr.visitor_messages(F.array(), None)


def test_no_phrases_drops_nothing(spark):
    assert set(shaped(spark, [])) == {"0", "1", "2"}


def test_ordered_concat_across_runs(spark):
    n = 5000
    rows = spark.range(n).select(
        F.lit("hot").alias("k"), F.col("id").alias("at"), F.col("id").cast("string").alias("v")
    )
    more = spark.createDataFrame([("b", 1, None), ("b", 0, "x"), (None, 0, "y")], "k string, at long, v string")
    joined = {r.k: r.v for r in tr.ordered_concat(rows.union(more), ["k"], "at", "v", separator="|").collect()}
    assert joined == {"hot": "|".join(map(str, range(n))), "b": "x|"}


def test_top_messages_breaks_ties_by_text(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "text string")
    assert [tuple(r) for r in tr.top_messages(rows, 2).collect()] == [("c", 2), ("a", 1)]


@pytest.mark.parametrize("most", [0, 1, 1000])
def test_repeated_ids_keep_their_own_texts(spark, most):
    """Two users under one ID: whether the list is inlined or joined, each keeps what was said to them."""
    rows = chats(spark, str([{"user_type": "visitor", "text": "first"}]), str([{"user_type": "visitor", "text": "second"}]))
    same = rows.withColumn("UserID", F.col("ID")).withColumn("ID", F.lit("1"))
    listed = spark.createDataFrame([("x",), ("y",)], "FilterMessages string")
    shaped = tr.shape_chats(same, listed, most_inline=most)
    assert sorted(r.text for r in shaped.collect()) == ["first", "second"]
    assert shaped.select("UserID").distinct().count() == 2


@pytest.mark.parametrize("inline", [True, False])
def test_census_names_every_outcome(spark, inline):
    most = 1000 if inline else 2
    talks = [str(t) for t in TALKS] + [str(TALKS[0])[:-3], None, "[]", "[{'text': undefined}]"]
    listed = spark.createDataFrame([(p,) for p in PHRASES], "FilterMessages string")
    counts = {r.outcome: r.chats for r in tr.transcript_census(chats(spark, *talks), listed, most_inline=most).collect()}
    assert counts == {"kept": 2, "only listed phrases": 2, "cut off": 3, "unreadable": 1}


def test_worker_functions_travel_by_value(tmp_path):
    payload = cloudpickle.dumps(tr._read_literal)
    literal = "[{'text': None, 'date': True}]"
    code = f"import pickle, sys; print(pickle.load(sys.stdin.buffer)({literal!r}))"
    done = subprocess.run([sys.executable, "-c", code], input=payload, capture_output=True, cwd=tmp_path, check=True)
    assert "'text': None" in done.stdout.decode() and "'date': 'true'" in done.stdout.decode()
