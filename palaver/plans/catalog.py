"""The catalogue: every operator as a query over the sample tables."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.numbers import fill_gaps as fill
from palaver.functions.numbers import half_even, nan_to_number
from palaver.functions.scores import label_of
from palaver.functions.text import (
    EMAIL_PATTERN,
    PHONE_PATTERN,
    URL_PATTERN,
    mask_emails,
    mask_phones,
    mask_pii,
    mask_urls,
    normalise_tokens,
    preview,
)
from palaver.functions.times import date_id, round_hour
from palaver.operators import dashboard as dash
from palaver.operators import density as kde
from palaver.operators import extract, filters, frequent, merge, ordering, quality, scoring, search, sketches
from palaver.operators import transcripts as tr
from palaver.plans import jobs
from palaver.plans.jobs import load_bucketed_facts, scored_facts, shaped_chats
from palaver.plans.registry import literal, mask_sql, query, round_hour_sql, scores_sql
from palaver.schemas import EMAIL_MASK, FACT, FACT_TABLE, NEAREST, PHONE_MASK, SENTIMENTS, URL_MASK
from palaver.session import fresh_path
from palaver.sources import clustered, files, sample, sinks, text_index
from palaver.sources.warehouse import run_query
from palaver.streaming import hourly, loads

CUTOFF = "2024-01-16 13:20:00"  # chats before it count as loaded earlier
AS_OF = "2024-01-31 00:00:00"
FILE_BLOCK = 8 << 20  # bytes of a row group in the files of a stream


# --- extraction ---------------------------------------------------------------------------------

JOINED = (
    "ID", "UserID", "VIPLevel", "Rating", "DurationInMins", "Brand", "CountryGroup1", "Date", "ChatType",
    "AgentDisplayName",
)


@query("chats_without_id", "SELECT ID, UserID FROM chats_v WHERE CAST(ID AS BIGINT) % 3 <> 0")
def chats_without_id(spark: SparkSession, sf: str) -> DataFrame:
    known = F.when(F.col("ID").cast("long") % 3 != 0, F.col("ID"))
    chats = sample.chats(spark, sf).withColumn("ID", known)
    return extract.chats_with_profile(chats, sample.profile(spark, sf)).select("ID", "UserID")


@query("chats_profile", f"SELECT {', '.join(JOINED)} FROM joined_v")
def chats_profile(spark: SparkSession, sf: str) -> DataFrame:
    return extract.chats_with_profile(sample.chats(spark, sf), sample.profile(spark, sf)).select(*JOINED)


@query("whole_minutes", "SELECT ID, duration // 60 AS minutes FROM chats_v")
def whole_minutes(spark: SparkSession, sf: str) -> DataFrame:
    joined = extract.chats_with_profile(
        sample.chats(spark, sf), sample.profile(spark, sf), integer_minutes=True
    )
    return joined.select("ID", F.col("DurationInMins").alias("minutes"))


@query("rolling_window", f"SELECT ID, started FROM chats_v WHERE started > TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY")
def rolling_window(spark: SparkSession, sf: str) -> DataFrame:
    return extract.started_within(sample.chats(spark, sf), AS_OF, 10).select("ID", "started")


def _loaded(spark: SparkSession, sf: str) -> DataFrame:
    return sample.fact(spark, sf).where(F.col("Date") < F.lit(CUTOFF).cast("timestamp_ntz"))


LOADED_SQL = f"SELECT * FROM fact_v WHERE Date < TIMESTAMP '{CUTOFF}'"


@query(
    "incremental_by_day",
    f"""SELECT ID, started FROM chats_v
        WHERE CAST(started AS DATE) > (SELECT COALESCE(max(Date), TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)
          FROM ({LOADED_SQL}))""",
)
def incremental_by_day(spark: SparkSession, sf: str) -> DataFrame:
    chats = sample.chats(spark, sf)
    return extract.not_yet_loaded(chats, _loaded(spark, sf), AS_OF, mode="day").select("ID", "started")


@query(
    "incremental_by_time",
    f"""SELECT ID, started FROM chats_v
        WHERE started > (SELECT COALESCE(max(Date), TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) FROM ({LOADED_SQL}))""",
)
def incremental_by_time(spark: SparkSession, sf: str) -> DataFrame:
    return extract.not_yet_loaded(sample.chats(spark, sf), _loaded(spark, sf), AS_OF).select("ID", "started")


@query(
    "incremental_first_load",
    f"SELECT ID, started FROM chats_v WHERE started > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY",
)
def incremental_first_load(spark: SparkSession, sf: str) -> DataFrame:
    chats = sample.chats(spark, sf)
    nothing = sample.fact(spark, sf).where(F.col("ChatID").isNull())
    return extract.not_yet_loaded(chats, nothing, AS_OF).select("ID", "started")


@query("max_loaded", "SELECT max(Date) AS max_date FROM fact_v")
def max_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return extract.max_loaded(sample.fact(spark, sf))


@query(
    "new_users",
    f"""SELECT ID, UserID FROM chats_v ch
        WHERE NOT EXISTS (SELECT 1 FROM fact_v f
          WHERE f.UserID = ch.UserID AND f.Date < TIMESTAMP '2024-01-01 12:00:00')""",
)
def new_users(spark: SparkSession, sf: str) -> DataFrame:
    early = sample.fact(spark, sf).where(F.col("Date") < F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))
    return extract.new_users(sample.chats(spark, sf), early).select("ID", "UserID")


@query(
    "sql_read",
    """SELECT event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY event_type""",
)
def sql_read(spark: SparkSession, sf: str) -> DataFrame:
    sample.table(spark, sf, "events").createOrReplaceTempView("events_read")
    return run_query(
        spark,
        "SELECT event_type, count(*) AS events, round(sum(value), 2) AS total FROM events_read GROUP BY event_type",
    )


# --- filters ------------------------------------------------------------------------------------

FILTERED_SQL = """
  Date BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-27 00:00:00' AND VIPLevel BETWEEN 0 AND 3
  AND CountryGroup1 IN ('AMERICA', 'ASIA', 'EUROPE')
  AND ChatType = 'Support Chat' AND Sentiment IN ('Negative', 'Positive') AND DurationInMins BETWEEN 2 AND 90
  AND AgentDisplayName IN ('Agent 0', 'Agent 2', 'Agent 4')"""

CHOSEN = filters.ChatFilter(
    date=("2024-01-03", "2024-01-27"),
    countries=("AMERICA", "ASIA", "EUROPE"),
    brands=("All Brands", "MACHINERY"),
    vip=(0, 3),
    chat_types=("Support Chat",),
    sentiments=("Negative", "Positive"),
    duration=(2, 90),
    agents=("Agent 0", "Agent 2", "Agent 4"),
)


@query("filter_all", f"SELECT * FROM fact_v WHERE {FILTERED_SQL}")
def filter_all(spark: SparkSession, sf: str) -> DataFrame:
    return CHOSEN.apply(sample.fact(spark, sf))


def _clustered(spark: SparkSession, sf: str) -> Callable[[filters.ChatFilter], DataFrame]:
    """The facts in a clustered table; gives what a filter leaves of it."""
    facts, path = sample.fact(spark, sf), fresh_path(spark, "clustered")
    clustered.write_clustered(facts, path)
    return lambda chosen: clustered.read_clustered(spark, path, facts.schema, chosen)


@query("clustered_filter_all", f"SELECT * FROM fact_v WHERE {FILTERED_SQL}")
def clustered_filter_all(spark: SparkSession, sf: str) -> DataFrame:
    return _clustered(spark, sf)(CHOSEN)


# A filter on each column of the curve alone, and on two of them.
CLUSTERED_FILTERS = {
    "date": (filters.ChatFilter(date=("2024-01-10", "2024-01-12")), "Date BETWEEN '2024-01-10' AND '2024-01-12'"),
    "vip": (filters.ChatFilter(vip=(4, None)), "VIPLevel >= 4"),
    "brand": (filters.ChatFilter(brands=("MACHINERY", "BUILDING")), "Brand IN ('MACHINERY', 'BUILDING')"),
    "country": (filters.ChatFilter(countries=("ASIA",)), "CountryGroup1 = 'ASIA'"),
    "brand and vip": (filters.ChatFilter(brands=("FURNITURE",), vip=(1, 2)), "Brand = 'FURNITURE' AND VIPLevel BETWEEN 1 AND 2"),
}


@query(
    "clustered_counts",
    " UNION ALL ".join(
        f"SELECT '{name}' AS chosen, count(*) AS chats, count(DISTINCT UserID) AS users FROM fact_v WHERE {where}"
        for name, (_, where) in CLUSTERED_FILTERS.items()
    ),
)
def clustered_counts(spark: SparkSession, sf: str) -> DataFrame:
    left_by = _clustered(spark, sf)
    return reduce(DataFrame.union, [
        left_by(chosen).agg(F.lit(name).alias("chosen"), F.count("*").alias("chats"), F.count_distinct("UserID").alias("users"))
        for name, (chosen, _) in CLUSTERED_FILTERS.items()
    ])


@query("filter_none", "SELECT * FROM fact_v")
def filter_none(spark: SparkSession, sf: str) -> DataFrame:
    chosen = filters.ChatFilter(countries=("All Countries", "ASIA"), agents=["All Agents"])
    return chosen.apply(sample.fact(spark, sf))


@query(
    "filter_end_day",
    """SELECT ChatID, Date FROM fact_v
       WHERE Date >= TIMESTAMP '2024-01-10 00:00:00' AND Date < TIMESTAMP '2024-01-13 00:00:00'""",
)
def filter_end_day(spark: SparkSession, sf: str) -> DataFrame:
    chosen = filters.ChatFilter(date=("2024-01-10", "2024-01-12"), end_inclusive_day=True)
    return chosen.apply(sample.fact(spark, sf)).select("ChatID", "Date")


RANGE_SQL = {
    "7d": "(SELECT max(Date) FROM spread) - INTERVAL 7 DAY",
    "1m": "(SELECT max(Date) FROM spread) - INTERVAL 1 MONTH",
    "6m": "(SELECT max(Date) FROM spread) - INTERVAL 6 MONTH",
    "ytd": "date_trunc('year', (SELECT max(Date) FROM spread))",
    "1y": "(SELECT max(Date) FROM spread) - INTERVAL 1 YEAR",
    "all": "TIMESTAMP '0001-01-01 00:00:00'",
}
# The sample's chats fall into one month; here they go back over two years from mid-June.
SPREAD_SQL = """SELECT ChatID, Date + INTERVAL 140 DAY - CAST(CAST(ChatID AS BIGINT) % 730 AS INT) * INTERVAL 1 DAY AS Date
  FROM fact_v"""


def _register_range(preset: str, start: str) -> None:
    @query(f"range_{preset}", f"WITH spread AS ({SPREAD_SQL}) SELECT ChatID, Date FROM spread WHERE Date >= {start}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        back = F.make_dt_interval((F.lit(140) - F.col("ChatID").cast("long") % 730).cast("int"))
        spread = sample.fact(spark, sf).select("ChatID", (F.col("Date") + back).alias("Date"))
        return filters.trailing_range(spread, preset)


for _preset, _start in RANGE_SQL.items():
    _register_range(_preset, _start)


@query("user_chats", "SELECT * FROM fact_v WHERE UserID = 8 AND ChatType = 'Support Chat'")
def user_chats(spark: SparkSession, sf: str) -> DataFrame:
    return filters.support_chats(filters.chats_of_user(sample.fact(spark, sf), 8))


# --- dashboard ----------------------------------------------------------------------------------

HOUR_SQL = round_hour_sql("Date")


@query("round_hour", f"SELECT event_id, {round_hour_sql('ts')} AS hour FROM events")
def rounded_hours(spark: SparkSession, sf: str) -> DataFrame:
    return sample.table(spark, sf, "events").select("event_id", round_hour(F.col("ts")).alias("hour"))


@query(
    "dashboard_counts",
    f"""WITH h AS (SELECT {HOUR_SQL} AS Date, Sentiment, CountryGroup1 FROM fact_v)
        SELECT 'per_hour' AS chart, Date, NULL AS value, count(*) AS chats FROM h GROUP BY 2
        UNION ALL SELECT 'hour_sentiment', Date, Sentiment, count(*) FROM h GROUP BY 2, 3
        UNION ALL SELECT 'hour_country', Date, CountryGroup1, count(*) FROM h GROUP BY 2, 3""",
)
def dashboard_counts(spark: SparkSession, sf: str) -> DataFrame:
    return dash.dashboard(sample.fact(spark, sf))["hourly"]


@query("per_hour", f"SELECT {HOUR_SQL} AS Date, count(*) AS chats FROM fact_v GROUP BY 1")
def per_hour(spark: SparkSession, sf: str) -> DataFrame:
    return dash.per_hour(sample.fact(spark, sf))


@query("hour_sentiment", f"SELECT {HOUR_SQL} AS Date, Sentiment, count(*) AS chats FROM fact_v GROUP BY 1, 2")
def hour_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return dash.per_hour(sample.fact(spark, sf), "Sentiment")


@query(
    "hour_country", f"SELECT {HOUR_SQL} AS Date, CountryGroup1, count(*) AS chats FROM fact_v GROUP BY 1, 2"
)
def hour_country(spark: SparkSession, sf: str) -> DataFrame:
    return dash.per_hour(sample.fact(spark, sf), "CountryGroup1")


@query(
    "filtered_hour_sentiment",
    f"SELECT {HOUR_SQL} AS Date, Sentiment, count(*) AS chats FROM fact_v WHERE {FILTERED_SQL} GROUP BY 1, 2",
)
def filtered_hour_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return dash.per_hour(CHOSEN.apply(sample.fact(spark, sf)), "Sentiment")


@query("vip_sentiment", "SELECT VIPLevel, Sentiment, count(*) AS chats FROM fact_v GROUP BY 1, 2")
def vip_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return dash.vip_by_sentiment(sample.fact(spark, sf))


@query(
    "vip_table",
    """SELECT VIPLevel AS "VIP Level", Sentiment AS "Sentiment", count(*) AS "No of Chats" FROM fact_v GROUP BY 1, 2""",
)
def vip_table(spark: SparkSession, sf: str) -> DataFrame:
    counts = dash.vip_by_sentiment(sample.fact(spark, sf))
    return search.rename_by_position(counts, "VIP Level", "Sentiment", "No of Chats")


@query(
    "vip_series",
    """SELECT lower(Sentiment) AS series, VIPLevel, Sentiment, count(*) AS chats FROM fact_v GROUP BY 2, 3""",
)
def vip_series(spark: SparkSession, sf: str) -> DataFrame:
    """The three series of the dashboard's VIP chart, one under the other."""
    charts = dash.dashboard(sample.fact(spark, sf))
    names = [label.lower() for label in SENTIMENTS]
    return reduce(
        DataFrame.unionByName, (charts[f"vip_{name}"].withColumn("series", F.lit(name)) for name in names)
    )


@query(
    "vip_pivot",
    f"""SELECT VIPLevel, {', '.join(f"count(*) FILTER (WHERE Sentiment = '{s}') AS {s}" for s in SENTIMENTS)}
        FROM fact_v GROUP BY VIPLevel""",
)
def vip_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return dash.vip_pivot(sample.fact(spark, sf))


@query("class_counts", "SELECT Sentiment, count(*) AS chats FROM fact_v GROUP BY 1")
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return dash.class_counts(sample.fact(spark, sf))


@query(
    "bounds",
    """SELECT min(Date) AS date_min, max(Date) + INTERVAL 1 DAY AS date_max,
         CAST(trunc(min(VIPLevel)) AS INT) AS viplevel_min, CAST(trunc(max(VIPLevel)) AS INT) AS viplevel_max,
         CAST(trunc(min(DurationInMins)) AS INT) AS durationinmin_min,
         CAST(trunc(max(DurationInMins)) AS INT) AS durationinmin_max
       FROM fact_v""",
)
def bounds(spark: SparkSession, sf: str) -> DataFrame:
    return dash.bounds(sample.fact(spark, sf))


@query(
    "options",
    """SELECT DISTINCT 'Brand' AS field, 1 AS place, Brand AS value FROM fact_v
       UNION ALL SELECT DISTINCT 'CountryGroup1', 1, CountryGroup1 FROM fact_v
       UNION ALL SELECT DISTINCT 'AgentDisplayName', 1, AgentDisplayName FROM fact_v
       UNION ALL VALUES ('Brand', 0, 'All Brands'), ('CountryGroup1', 0, 'All Countries'),
         ('AgentDisplayName', 0, 'All Agents')""",
)
def options(spark: SparkSession, sf: str) -> DataFrame:
    return dash.options(sample.fact(spark, sf))


@query(
    "chat_types",
    """SELECT ChatType, Date AS first_date, ChatID AS first_chat
       FROM (SELECT *, row_number() OVER (PARTITION BY ChatType ORDER BY Date, ChatID) AS rn FROM fact_v)
       WHERE rn = 1""",
)
def chat_types(spark: SparkSession, sf: str) -> DataFrame:
    return dash.chat_types(sample.fact(spark, sf))


@query(
    "row_counts",
    f"""SELECT count(*) AS table_rows, count(*) FILTER (WHERE {FILTERED_SQL}) AS hits FROM fact_v""",
)
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    fact = sample.fact(spark, sf)
    return dash.totals(fact, CHOSEN.apply(fact))


def _density_sql(value: str, points: int, cut: float, steps: int) -> str:
    return f"""
      WITH weighted AS (SELECT Sentiment, {value} AS v, count(*) AS w FROM fact_v GROUP BY 1, 2),
      classes AS (SELECT Sentiment, count(*) AS n, min({value}) AS lo, max({value}) AS hi,
          stddev_samp({value}) * pow(count(*), -0.2) AS h FROM fact_v GROUP BY 1 HAVING count(*) > 1),
      grid AS (SELECT c.*, i, (lo - {cut} * h) + i * (hi - lo + 2 * {cut} * h) / {steps} AS x
        FROM classes c, range({points}) g(i) WHERE h > 0)
      SELECT Sentiment, CAST(i AS INT) AS i, round(x, 6) AS x,
        round(sum(w * exp(-0.5 * pow((x - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density
      FROM grid JOIN weighted USING (Sentiment) GROUP BY Sentiment, i, x"""


def _rounded_density(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": F.round("x", 6), "density": F.round("density", 9)})


@query("density", _density_sql("DurationInMins", 500, 0.0, 500))
def density(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_density(kde.density(sample.fact(spark, sf)))


@query("density_wide", _density_sql("round(DurationInMins, 0)", 200, 3.0, 199))
def density_wide(spark: SparkSession, sf: str) -> DataFrame:
    curve = kde.density(sample.fact(spark, sf), points=200, cut=3.0, closed=True, round_to=0)
    return _rounded_density(curve)


BOUNDED_SQL = """SELECT Sentiment, i, x, TRUE AS within_bound FROM ({})"""


@query("density_binned", BOUNDED_SQL.format(_density_sql("DurationInMins", 500, 0.0, 500)))
def density_binned(spark: SparkSession, sf: str) -> DataFrame:
    """The grid of the binned curve, and whether it lies within its stated bound of the exact one."""
    facts = sample.fact(spark, sf)
    exact = kde.density(facts).select("Sentiment", "i", F.col("density").alias("exact"))
    binned = kde.density_binned(facts).join(exact, ["Sentiment", "i"], "full")
    close = F.coalesce(F.abs(F.col("density") - F.col("exact")) <= F.col("error") + F.lit(1e-12), F.lit(False))
    return binned.select("Sentiment", "i", F.round("x", 6).alias("x"), close.alias("within_bound"))


# --- transcripts --------------------------------------------------------------------------------


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    complete = tr.complete_transcripts(sample.transcripts(spark, sf))
    return tr.parse_transcripts(complete, dialect="json")


@query("parse_literals", "SELECT Key, pos, user_type, date, text FROM turns_v")
def parse_literals(spark: SparkSession, sf: str) -> DataFrame:
    complete = tr.complete_transcripts(sample.literal_transcripts(spark, sf))
    return tr.explode_messages(tr.parse_transcripts(complete, dialect="native")).drop("author_name", "agent_id")


@query("literal_census", "SELECT 'native' AS read, count(DISTINCT Key) AS transcripts FROM turns_v")
def literal_census(spark: SparkSession, sf: str) -> DataFrame:
    return tr.literal_census(sample.literal_transcripts(spark, sf))


@query("explode_messages", "SELECT Key, pos, author_name, user_type, date, text FROM turns_v")
def explode_messages(spark: SparkSession, sf: str) -> DataFrame:
    return tr.explode_messages(_parsed(spark, sf)).drop("agent_id")


@query("html_transcript", "SELECT Key, html_text FROM html_v")
def html_transcript(spark: SparkSession, sf: str) -> DataFrame:
    html = tr.html_transcript(F.col("transcript")).alias("html_text")
    return _parsed(spark, sf).select(F.col("ID").alias("Key"), html)


@query("html_from_messages", "SELECT Key, html_text FROM html_v")
def html_from_messages(spark: SparkSession, sf: str) -> DataFrame:
    return tr.html_by_key(sample.turns(spark, sf))


@query(
    "html_escaped",
    """SELECT Key, string_agg('<b>' || author_name || ' (' || user_type || ') on ' || date || '</b><br>'
         || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '<br><br>', '' ORDER BY pos)
         AS html_text FROM turns_v GROUP BY Key""",
)
def html_escaped(spark: SparkSession, sf: str) -> DataFrame:
    return tr.html_by_key(sample.turns(spark, sf), escape=True)


@query("visitor_text", "SELECT Key, text FROM visitor_v")
def visitor_text(spark: SparkSession, sf: str) -> DataFrame:
    spoken = tr.visitor_messages(F.col("transcript")).alias("_visitor")
    chats = _parsed(spark, sf).select(F.col("ID").alias("Key"), spoken)
    return tr.with_visitor_text(chats, sample.phrases(spark, sf)).where(F.col("text").isNotNull())


@query("visitor_text_from_messages", "SELECT Key, text FROM visitor_v")
def visitor_text_from_messages(spark: SparkSession, sf: str) -> DataFrame:
    return tr.visitor_text_by_key(sample.turns(spark, sf), sample.phrases(spark, sf))


@query(
    "drop_listed_messages",
    """SELECT Key, pos, text FROM turns_v
       WHERE NOT EXISTS (SELECT 1 FROM phrases_v WHERE FilterMessages = text)""",
)
def drop_listed_messages(spark: SparkSession, sf: str) -> DataFrame:
    messages = sample.turns(spark, sf).select("Key", "pos", "text")
    return tr.drop_listed(messages, sample.phrases(spark, sf))


# Whole messages hardly repeat in the sample; their words do, and there are more of them than are kept.
TOP_SQL = """SELECT text, count(*) AS messages FROM (SELECT unnest(string_split(text, ' ')) AS text FROM turns_v)
  GROUP BY text ORDER BY messages DESC, text LIMIT 1000"""


def _said(spark: SparkSession, sf: str) -> DataFrame:
    return sample.turns(spark, sf).select(F.explode(F.split("text", " ")).alias("text"))


@query("top_messages", TOP_SQL)
def top_messages(spark: SparkSession, sf: str) -> DataFrame:
    return tr.top_messages(_said(spark, sf), 1000)


@query("frequent_messages", TOP_SQL)
def frequent_messages(spark: SparkSession, sf: str) -> DataFrame:
    return frequent.frequent_messages(_said(spark, sf), 1000)[0]


@query(
    "frequent_words",
    """SELECT text, count(*) AS messages FROM (SELECT unnest(string_split(text, ' ')) AS text FROM documents)
       GROUP BY text ORDER BY messages DESC, text LIMIT 20""",
)
def frequent_words(spark: SparkSession, sf: str) -> DataFrame:
    words = sample.table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("text"))
    return frequent.frequent_messages(words, 20)[0]


@query(
    "union_unlike",
    """SELECT Key, pos, text, author_name, NULL AS agent_id FROM turns_v WHERE user_type = 'visitor'
       UNION ALL SELECT Key, pos, text, NULL, author_name FROM turns_v WHERE user_type <> 'visitor'""",
)
def union_unlike(spark: SparkSession, sf: str) -> DataFrame:
    turns = sample.turns(spark, sf)
    visitors = turns.where("user_type = 'visitor'").select("Key", "pos", "text", "author_name")
    others = turns.where("user_type <> 'visitor'").select("Key", "pos", "text", F.col("author_name").alias("agent_id"))
    return visitors.unionByName(others, allowMissingColumns=True)


@query(
    "transcript_census",
    """SELECT CASE CAST(h.Key AS BIGINT) % 10 WHEN 3 THEN 'cut off' WHEN 4 THEN 'unreadable' ELSE
         CASE WHEN v.Key IS NULL THEN 'only listed phrases' ELSE 'kept' END END AS outcome, count(*) AS chats
       FROM html_v h LEFT JOIN visitor_v v USING (Key) GROUP BY 1""",
)
def transcript_census(spark: SparkSession, sf: str) -> DataFrame:
    place = F.col("ID").cast("long") % 10
    damaged = sample.transcripts(spark, sf).withColumn(
        "Messages",
        F.when(place == 3, F.expr("substring(Messages, 1, length(Messages) - 5)"))
        .when(place == 4, F.concat(F.lit("[{"), F.col("Messages")))
        .otherwise(F.col("Messages")),
    )
    return tr.transcript_census(damaged, sample.phrases(spark, sf))


@query(
    "shaped_repeated_ids",
    """SELECT ID, UserID, v.text AS text FROM chats_v JOIN visitor_v v ON v.Key = ID
       UNION ALL SELECT ID, UserID + 1000, v.text FROM chats_v
         JOIN visitor_v v ON CAST(v.Key AS BIGINT) = CAST(ID AS BIGINT) + 1""",
)
def shaped_repeated_ids(spark: SparkSession, sf: str, most_inline: int = 0) -> DataFrame:
    """Two users' chats under each ID, the phrase list as a join."""
    chats, transcripts = sample.chats(spark, sf).drop("Messages"), sample.transcripts(spark, sf)
    earlier = (F.col("ID").cast("long") - 1).cast("string")
    second = chats.withColumn("UserID", F.col("UserID") + 1000).join(transcripts.withColumn("ID", earlier), "ID")
    both = chats.join(transcripts, "ID").unionByName(second).select("ID", "UserID", "Messages")
    return tr.shape_chats(both, sample.phrases(spark, sf), most_inline=most_inline).select("ID", "UserID", "text")


@query("phrase_file", "SELECT DISTINCT FilterMessages FROM phrases_v UNION ALL SELECT 'a \"quoted\", é 日本'")
def phrase_file(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "phrases-csv")
    odd = spark.range(1).select(F.lit('a "quoted", é 日本').alias("FilterMessages"))
    sinks.write_csv(sample.phrases(spark, sf).union(odd), path)
    return files.read_phrases(spark, path)


SHAPED = ("ID", "UserID", "Date", "ChatType", "text", "html_text")


@query("shaped_chats", f"SELECT {', '.join(SHAPED)} FROM shaped_v")
def shaped(spark: SparkSession, sf: str) -> DataFrame:
    return _shaped(spark, sf).select(*SHAPED)


def _shaped(spark: SparkSession, sf: str) -> DataFrame:
    chats, profile = sample.chats_with_transcripts(spark, sf), sample.profile(spark, sf)
    return shaped_chats(chats, profile, sample.phrases(spark, sf), days=None)


# --- masking and tokens -------------------------------------------------------------------------


@query("mask_documents", f"SELECT doc_id, {mask_sql('text')} AS text FROM documents")
def mask_documents(spark: SparkSession, sf: str) -> DataFrame:
    return sample.table(spark, sf, "documents").select("doc_id", mask_pii(F.col("text")).alias("text"))


@query(
    "mask_conversations",
    f"SELECT conv_id, turn, {mask_sql('text')} AS text FROM conversations",
)
def mask_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return sample.table(spark, sf, "conversations").select("conv_id", "turn", mask_pii(F.col("text")).alias("text"))


@query(
    "mask_pages",
    f"SELECT page_id, {mask_sql('url')} AS url, {mask_sql('html')} AS html FROM pages",
)
def mask_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = sample.table(spark, sf, "pages")
    return pages.select("page_id", mask_pii(F.col("url")).alias("url"), mask_pii(F.col("html")).alias("html"))


def _register_mask(mask: Callable[[Column], Column], pattern: str, word: str) -> None:
    sql = f"SELECT page_id, regexp_replace(html, {literal(pattern)}, {literal(word)}, 'g') AS html FROM pages"

    @query(mask.__name__, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return sample.table(spark, sf, "pages").select("page_id", mask(F.col("html")).alias("html"))


_register_mask(mask_emails, EMAIL_PATTERN, EMAIL_MASK)
_register_mask(mask_phones, PHONE_PATTERN, PHONE_MASK)
_register_mask(mask_urls, URL_PATTERN, URL_MASK)


@query(
    "normalise_tokens",
    """SELECT page_id, array_to_string(list_transform(string_split(url || ' @' || url || ' ' || html, ' '),
         lambda t: CASE WHEN starts_with(t, '@') AND length(t) > 1 THEN '@user'
                   WHEN starts_with(t, 'http') THEN 'http' ELSE t END), ' ') AS text
       FROM pages""",
)
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("url", F.lit(" @"), "url", F.lit(" "), "html")
    return sample.table(spark, sf, "pages").select("page_id", normalise_tokens(text).alias("text"))


@query(
    "preview",
    "SELECT doc_id, substring(text, 1, 100) || '...' AS preview FROM documents",
)
def previews(spark: SparkSession, sf: str) -> DataFrame:
    return sample.table(spark, sf, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


@query("half_even_minutes", "SELECT ChatID, round_even(DurationInMins, 0) AS minutes FROM fact_v")
def half_even_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return sample.fact(spark, sf).select("ChatID", half_even(F.col("DurationInMins")).alias("minutes"))


# --- scoring ------------------------------------------------------------------------------------

ROUNDED_SCORES = ", ".join(f"round({s}, 6) AS {s}" for s in SENTIMENTS)
DOC_SCORES_SQL = f"SELECT doc_id, {ROUNDED_SCORES}, Sentiment FROM ({scores_sql('documents', 'text')})"


def _rounded_scores(df: DataFrame) -> DataFrame:
    return df.withColumns({s: F.round(s, 6) for s in SENTIMENTS})


def _scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_by_lexicon(sample.table(spark, sf, "documents").select("doc_id", "text")).drop("text")


@query("lexicon_score", DOC_SCORES_SQL)
def lexicon_score(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_scores(_scored_documents(spark, sf))


@query("batch_score", DOC_SCORES_SQL)
def batch_score(spark: SparkSession, sf: str) -> DataFrame:
    texts = sample.table(spark, sf, "documents").select("doc_id", "text")
    spread = spark.sparkContext.defaultParallelism
    return _rounded_scores(scoring.score_batches(texts, scoring.lexicon_scorer, spread=spread)).drop("text")


@query(
    "class_ranks",
    f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, place) AS INT) AS rank, label,
          round(s, 6) AS score
        FROM (SELECT doc_id, unnest([0, 1, 2]) AS place, unnest(['Negative', 'Neutral', 'Positive']) AS label,
                unnest([Negative, Neutral, Positive]) AS s
              FROM ({scores_sql('documents', 'text')}))""",
)
def class_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.class_ranks(_scored_documents(spark, sf), "doc_id").withColumn("score", F.round("score", 6))


@query(
    "best_class",
    f"""SELECT doc_id, Sentiment AS label, round(greatest(Negative, Neutral, Positive), 6) AS score
        FROM ({scores_sql('documents', 'text')})""",
)
def best_class(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.best_class(_scored_documents(spark, sf), "doc_id").withColumn("score", F.round("score", 6))


@query(
    "scores_by_label",
    f"""SELECT doc_id, unnest(['Negative', 'Neutral', 'Positive']) AS label,
          round(unnest([Negative, Neutral, Positive]), 6) AS score
        FROM ({scores_sql('documents', 'text')})""",
)
def scores_by_label(spark: SparkSession, sf: str) -> DataFrame:
    maps = scoring.scores_by_label(_scored_documents(spark, sf), "doc_id")
    scores = maps.select("doc_id", F.explode_outer("scores").alias("label", "score"))
    return scores.withColumn("score", F.round("score", 6))


@query("unpack_scores", DOC_SCORES_SQL)
def unpack_scores(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _scored_documents(spark, sf).select("doc_id", F.array(*SENTIMENTS).alias("scores"))
    return _rounded_scores(scoring.unpack_scores(vectors))


@query(
    "very_positive",
    f"""SELECT doc_id, Sentiment = 'Positive' AND Positive >= 0.8 AS very_positive
        FROM ({scores_sql('documents', 'text')})""",
)
def very_positive(spark: SparkSession, sf: str) -> DataFrame:
    return search.with_very_positive(_scored_documents(spark, sf)).select("doc_id", "very_positive")


@query(
    "classifier_score",
    """SELECT doc_id, true AS sums_to_one, true AS label_is_best, md5(text) AS scored_text FROM documents""",
)
def classifier_score(spark: SparkSession, sf: str) -> DataFrame:
    documents = sample.table(spark, sf, "documents").select("doc_id", "text")
    labelled = documents.join(sample.table(spark, sf, "labels"), "doc_id").select(
        "text", scoring.class_of_labels(F.col("quality"), F.col("toxic")).alias("label")
    )
    scored = scoring.score_by_classifier(documents, scoring.train_classifier(labelled))
    scores = F.array(*SENTIMENTS)
    return scored.select(
        "doc_id",
        (F.abs(sum(F.col(c) for c in SENTIMENTS) - 1) < 1e-9).alias("sums_to_one"),
        (F.get(scores, F.array_position(F.array(*map(F.lit, SENTIMENTS)), F.col("Sentiment")).cast("int") - 1)
         == F.array_max(scores)).alias("label_is_best"),
        F.md5("text").alias("scored_text"),  # of the text as the scored row has it
    )


@query(
    "training_classes",
    """SELECT CASE WHEN toxic = 1 THEN 'Negative' WHEN quality = 1 THEN 'Positive' ELSE 'Neutral' END AS label,
         count(*) AS documents
       FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
)
def training_classes(spark: SparkSession, sf: str) -> DataFrame:
    label = label_of(scoring.class_of_labels(F.col("quality"), F.col("toxic")))
    documents = sample.table(spark, sf, "documents").select("doc_id")
    joined = documents.join(sample.table(spark, sf, "labels"), "doc_id")
    return joined.groupBy(label.alias("label")).agg(F.count("*").alias("documents"))


@query("scored_facts", "SELECT * REPLACE (" + ROUNDED_SCORES + ") FROM scored_v")
def scored(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_scores(_scored(spark, sf))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return scored_facts(_shaped(spark, sf))


BATCH_ORDER = "row_number() OVER (ORDER BY Date, ChatID) - 1"


@query(
    "insert_batches",
    f"""SELECT batch, count(*) AS chats, min(Date) AS first_date, max(Date) AS last_date
        FROM (SELECT Date, CAST(({BATCH_ORDER}) // 1000 AS BIGINT) AS batch FROM fact_v) GROUP BY batch""",
)
def insert_batches(spark: SparkSession, sf: str) -> DataFrame:
    batches = ordering.fixed_batches(sample.fact(spark, sf).select("Date", "ChatID"), 1000, ["Date", "ChatID"])
    return batches.groupBy("batch").agg(
        F.count("*").alias("chats"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date")
    )


@query(
    "near_equal_parts",
    """SELECT CAST(ntile(7) OVER (ORDER BY Date, ChatID) - 1 AS BIGINT) AS part, ChatID FROM fact_v""",
)
def near_equal_parts(spark: SparkSession, sf: str) -> DataFrame:
    chats = sample.fact(spark, sf).select("Date", "ChatID")
    return ordering.near_equal_parts(chats, 7, ["Date", "ChatID"]).select("part", "ChatID")


# --- quality ------------------------------------------------------------------------------------


def _per_column(columns: tuple[str, ...], source: str, expression: str, name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {expression.format(c=c)} AS {name} FROM {source}" for c in columns
    )


@query("null_census", _per_column(JOINED, "joined_v", "count(*) FILTER (WHERE {c} IS NULL)", "nulls"))
def null_census(spark: SparkSession, sf: str) -> DataFrame:
    return quality.null_census(chats_profile(spark, sf))


@query("imputed_null_census", _per_column(JOINED[2:], "fact_v", "count(*) FILTER (WHERE {c} IS NULL)", "nulls"))
def imputed_null_census(spark: SparkSession, sf: str) -> DataFrame:
    imputed = quality.impute(chats_profile(spark, sf))
    return quality.null_census(quality.require_no_nulls(imputed).select(*JOINED[2:]))


DISTINCT_COLUMNS = ("UserID", "VIPLevel", "Rating", "Brand", "CountryGroup1", "ChatType", "AgentDisplayName")


@query("distinct_counts", _per_column(DISTINCT_COLUMNS, "joined_v", "count(DISTINCT {c})", "distinct_values"))
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.distinct_counts(chats_profile(spark, sf).select(*DISTINCT_COLUMNS))


# Whole days, alone and with choices of the dimensions that sketches are kept by.
SKETCH_RANGES = {
    "all": (filters.ChatFilter(), "TRUE"),
    "week": (
        filters.ChatFilter(date=("2024-01-08", "2024-01-14"), end_inclusive_day=True),
        "Date >= '2024-01-08' AND Date < '2024-01-15'",
    ),
    "week, country": (
        filters.ChatFilter(date=("2024-01-08", "2024-01-14"), end_inclusive_day=True, countries=("ASIA", "EUROPE")),
        "Date >= '2024-01-08' AND Date < '2024-01-15' AND CountryGroup1 IN ('ASIA', 'EUROPE')",
    ),
    "brand, sentiment": (
        filters.ChatFilter(brands=("MACHINERY",), sentiments=("Negative", "Positive")),
        "Brand = 'MACHINERY' AND Sentiment IN ('Negative', 'Positive')",
    ),
    "nothing": (filters.ChatFilter(brands=("no such brand",)), "FALSE"),
}


@query(
    "distinct_by_range",
    " UNION ALL ".join(
        f"SELECT '{name}' AS chosen, '{c}' AS column_name, count(DISTINCT {c}) AS exact, TRUE AS within_bound FROM fact_v WHERE {where}"
        for name, (_, where) in SKETCH_RANGES.items()
        for c in sketches.COLUMNS
    ),
)
def distinct_by_range(spark: SparkSession, sf: str) -> DataFrame:
    """Exact counts, and whether sketches stored in two loads and united come within their bound of them."""
    facts, path = sample.fact(spark, sf), fresh_path(spark, "sketches")
    early = F.col("Date") < F.lit("2024-01-11 09:00:00").cast("timestamp_ntz")  # a day that both loads share
    for load in (facts.where(early), facts.where(~early)):
        sinks.append(sketches.daily_sketches(load), path)
    stored = spark.read.parquet(path)
    told = []
    for name, (chosen, _) in SKETCH_RANGES.items():
        exact = quality.distinct_counts(chosen.apply(facts).select(*sketches.COLUMNS)).withColumnRenamed("distinct_values", "exact")
        close = F.abs(F.col("distinct_values") - F.col("exact")) <= F.ceil(F.col("exact") * sketches.error_bound())
        told.append(exact.join(sketches.estimates(stored, chosen), "column_name").select(
            F.lit(name).alias("chosen"), "column_name", "exact", close.alias("within_bound")
        ))
    return reduce(DataFrame.union, told)


@query("distinct_values", "SELECT DISTINCT user_type FROM turns_v")
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return quality.distinct_values(sample.turns(spark, sf), "user_type")


EVENT_NUMBERS = ("event_id", "user_id", "value")


WHOLE_NUMBERS = ("event_id", "user_id")


@query(
    "ranges_from_footers",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM events"
        for c in WHOLE_NUMBERS
    ),
)
def ranges_from_footers(spark: SparkSession, sf: str) -> DataFrame:
    return quality.ranges_from_footers(spark, f"{sf}/events.parquet", WHOLE_NUMBERS)


@query(
    "numeric_ranges",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM events"
        for c in EVENT_NUMBERS
    ),
)
def numeric_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return quality.numeric_ranges(sample.table(spark, sf, "events"))


@query(
    "narrow_report",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, low, high,
              CASE WHEN low > -128 AND high < 127 THEN 'tinyint' WHEN low > -32768 AND high < 32767 THEN 'smallint'
                WHEN low > -2147483648 AND high < 2147483647 THEN 'int' ELSE 'bigint' END AS narrow_type
            FROM (SELECT CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM events)"""
        for c in EVENT_NUMBERS[:2]
    ),
)
def narrow_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.narrow_report(sample.table(spark, sf, "events"))


@query("narrow_types", "SELECT event_id, user_id, value FROM events")
def narrow_types(spark: SparkSession, sf: str) -> DataFrame:
    return quality.narrow_types(sample.table(spark, sf, "events").select(*EVENT_NUMBERS))


# Event values with nulls, NaN and infinities among them.
ODD_SQL = """(SELECT event_id, user_id, CASE event_id % 10 WHEN 1 THEN CAST('nan' AS DOUBLE)
  WHEN 2 THEN CAST('infinity' AS DOUBLE) WHEN 3 THEN CAST('-infinity' AS DOUBLE) WHEN 4 THEN NULL ELSE value END AS odd
  FROM events)"""
ODD = ("event_id", "user_id", "odd")


def _odd_numbers(spark: SparkSession, sf: str) -> DataFrame:
    place = F.col("event_id") % 10
    odd = F.when(place == 1, float("nan")).when(place == 2, float("inf")).when(place == 3, -float("inf"))
    events = sample.table(spark, sf, "events")
    return events.select("event_id", "user_id", odd.when(place != 4, F.col("value")).alias("odd"))


@query(
    "clean_numbers",
    f"""SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id, odd FROM {ODD_SQL}
        WHERE isfinite(odd)""",
)
def clean_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return quality.clean_numbers(_odd_numbers(spark, sf))


@query("complete_rows", "SELECT ID, Brand FROM joined_v WHERE Brand IS NOT NULL")
def complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    return quality.complete_rows(chats_profile(spark, sf), "Brand").select("ID", "Brand")


@query(
    "finite_census",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE isnan(CAST({c} AS DOUBLE))) AS nan_count,
              count(*) FILTER (WHERE isinf(CAST({c} AS DOUBLE))) AS inf_count,
              count(*) FILTER (WHERE isfinite(CAST({c} AS DOUBLE))) AS finite_count FROM {ODD_SQL}"""
        for c in ODD
    ),
)
def finite_census(spark: SparkSession, sf: str) -> DataFrame:
    return quality.finite_census(_odd_numbers(spark, sf))


@query(
    "all_finite",
    f"""SELECT bool_and(odd IS NOT NULL AND isfinite(odd)) AS all_finite,
          bool_or(odd IS NOT NULL AND isfinite(odd)) AS any_finite FROM {ODD_SQL}""",
)
def all_finite(spark: SparkSession, sf: str) -> DataFrame:
    return quality.all_finite(_odd_numbers(spark, sf).select("odd"))


@query(
    "fill_gaps",
    f"SELECT event_id, CASE WHEN isfinite(odd) THEN odd ELSE 999 END AS odd FROM {ODD_SQL}",
)
def fill_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return _odd_numbers(spark, sf).select("event_id", fill(F.col("odd")).alias("odd"))


@query(
    "nan_to_number",
    f"""SELECT event_id, CASE WHEN isnan(odd) THEN 0 WHEN odd = CAST('infinity' AS DOUBLE) THEN {sys.float_info.max!r}
          WHEN odd = CAST('-infinity' AS DOUBLE) THEN -{sys.float_info.max!r} ELSE odd END AS odd FROM {ODD_SQL}""",
)
def nan_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _odd_numbers(spark, sf).select("event_id", nan_to_number(F.col("odd")).alias("odd"))


@query(
    "repeated_keys",
    "SELECT user_id, count(*) AS copies FROM events GROUP BY user_id HAVING count(*) > 1",
)
def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    return quality.repeated_keys(sample.table(spark, sf, "events"), "user_id")


# --- loads --------------------------------------------------------------------------------------


@query(
    "insert_only_merge",
    f"""SELECT * FROM ({LOADED_SQL}) UNION ALL
        SELECT * FROM fact_v f WHERE NOT EXISTS
          (SELECT 1 FROM ({LOADED_SQL}) t WHERE t.UserID = f.UserID AND t.ChatID = f.ChatID)""",
)
def insert_only_merge(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "fact")
    sinks.append(_loaded(spark, sf), path)
    facts = sample.fact(spark, sf)
    target = spark.read.schema(facts.schema).parquet(path)
    sinks.append(merge.rows_to_insert(facts, target, ["UserID", "ChatID"], ["Date"]), path)
    return spark.read.schema(facts.schema).parquet(path)


@query(
    "merge_repeated_keys",
    """SELECT CAST(user_id AS BIGINT) AS UserID, event_type AS Kind, min(event_id) AS first_event
       FROM events GROUP BY 1, 2""",
)
def merge_repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    events = sample.table(spark, sf, "events").select(
        F.col("user_id").alias("UserID"), F.col("event_type").alias("Kind"), F.col("event_id").alias("first_event")
    )
    empty = events.limit(0)
    return merge.insert_only_merge(events, empty, ["UserID", "Kind"], ["first_event"])


@query(
    "merge_nearest",
    f"""SELECT user_id AS UserID, event_id AS UserID_VIP, value AS Distance, event_type AS Country, RN
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, RN
                ORDER BY ts >= TIMESTAMP '{CUTOFF}', value, event_id) AS place
              FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS RN FROM events))
        WHERE place = 1""",
)
def merge_nearest(spark: SparkSession, sf: str) -> DataFrame:
    events = sample.table(spark, sf, "events")

    def nearest(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col("user_id").alias("UserID_newplayers"),
            F.col("event_id").alias("UserID_vip"),
            F.col("value").alias("distance"),
            F.col("event_type").alias("Country"),
            F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("RN"),
        )

    early = events.where(F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz"))
    path = fresh_path(spark, "nearest")
    sinks.create_table(spark, path, NEAREST)
    for batch in (early, events):
        stored = spark.read.schema(NEAREST).parquet(path)
        sinks.append(merge.new_nearest(nearest(batch), stored), path)
    return spark.read.schema(NEAREST).parquet(path)


@query(
    "replace_partition",
    """WITH rows AS (SELECT ID, UserID, duration * 2 AS duration, nullif(COALESCE(tags, ''), '') AS tags,
         CAST(strftime(started, '%Y%m%d') AS INT) AS TransactionDateID
         FROM chats_v WHERE started >= TIMESTAMP '2024-01-28 00:00:00')
       SELECT * FROM rows UNION ALL
       SELECT ID, UserID, duration, tags, CAST(strftime(started, '%Y%m%d') AS INT) AS TransactionDateID
       FROM chats_v
       WHERE CAST(strftime(started, '%Y%m%d') AS INT) <> (SELECT max(TransactionDateID) FROM rows)""",
)
def replace_partition(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "daily")
    stored = sample.chats(spark, sf).select(
        "ID", "UserID", "duration", "tags", date_id(F.col("started")).alias("TransactionDateID")
    )
    stored.hint("rebalance", "TransactionDateID").write.partitionBy("TransactionDateID").parquet(path)
    recent = sample.chats(spark, sf).where(F.col("started") >= F.lit("2024-01-28").cast("timestamp_ntz"))
    rows = recent.select(
        "ID",
        "UserID",
        (F.col("duration") * 2).alias("duration"),
        F.coalesce("tags", F.lit("")).alias("tags"),
        date_id(F.col("started")).alias("CurrentDate"),
    )
    sinks.replace_newest_partition(rows, path)
    return spark.read.schema(stored.schema).parquet(path)


@query(
    "backfill_null",
    """SELECT t.ID AS ID, t.UserID AS UserID, COALESCE(t.VIPLevel, f.level) AS VIPLevel FROM joined_v t
       LEFT JOIN (SELECT user_id, CAST(arg_min(length(event_type), event_id) AS INT) AS level FROM events GROUP BY 1) f
         ON f.user_id = t.UserID""",
)
def backfill_null(spark: SparkSession, sf: str) -> DataFrame:
    target = chats_profile(spark, sf).select("ID", "UserID", "VIPLevel")
    source = sample.table(spark, sf, "events").select(
        F.col("user_id").alias("UserID"), F.length("event_type").alias("VIPLevel"), "event_id"
    )
    return merge.backfill_nulls(target, source, ["UserID"], "VIPLevel", "event_id")


@query(
    "backfill_partitions",
    """SELECT t.ID AS ID, t.UserID AS UserID, CAST(t.Date AS DATE) AS day, COALESCE(t.VIPLevel, f.level) AS VIPLevel FROM joined_v t
       LEFT JOIN (SELECT user_id, CAST(arg_min(length(event_type), event_id) AS INT) AS level FROM events
                  WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1) f ON f.user_id = t.UserID""",
)
def backfill_partitions(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "days")
    target = chats_profile(spark, sf).select("ID", "UserID", "VIPLevel", F.to_date("Date").alias("day"))
    target.hint("rebalance", "day").write.partitionBy("day").parquet(path)
    source = sample.table(spark, sf, "events").where(F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz")).select(
        F.col("user_id").alias("UserID"), F.length("event_type").alias("VIPLevel"), "event_id"
    )
    jobs.backfill_partitions(spark, path, target.schema, "day", source, ["UserID"], "VIPLevel", "event_id")
    return spark.read.schema(target.schema).parquet(path)


@query(
    "backfill_key",
    """SELECT ID, UserID, hour(started) AS Hour, COALESCE(f.ChatID, 'lost') AS ChatID FROM chats_v
       LEFT JOIN (SELECT UserID AS u, hour(started) AS h, min(ID) AS ChatID FROM chats_v WHERE rate = 'rated_good' GROUP BY 1, 2) f
         ON u = UserID AND h = hour(started)""",
)
def backfill_key(spark: SparkSession, sf: str) -> DataFrame:
    chats = sample.chats(spark, sf).withColumn("Hour", F.hour("started").cast("long"))
    good = chats.where("rate = 'rated_good'").select(F.col("ID").alias("ChatID"), "UserID", "Hour")
    lost = chats.select("ID", "UserID", "Hour", F.lit("lost").alias("ChatID"))
    return merge.backfill_key(lost, good, ["UserID", "Hour"], "ChatID", "ChatID")


AUDIT_SQL = f"""SELECT 'chat sentiment' AS Project, 'predict' AS TrainOrPredict, round(avg(Negative), 6) AS Stat1,
          'mean Negative score' AS Stat1Desc, round(avg(Neutral), 6) AS Stat2, 'mean Neutral score' AS Stat2Desc,
          round(avg(Positive), 6) AS Stat3, 'mean Positive score' AS Stat3Desc, count(*) AS RecordCount,
          'documents' AS Comments
        FROM ({scores_sql('documents', 'text')})"""


@query("audit_row", AUDIT_SQL)
def audit_row(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "audit")
    row = merge.audit_row(_scored_documents(spark, sf), "chat sentiment", "predict", "documents")
    sinks.append(row, path)
    return spark.read.schema(row.schema).parquet(path)


@query("observed_audit", AUDIT_SQL)
def observed_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The audit row out of the metrics that the stage's own write observed."""
    path = fresh_path(spark, "audit")
    _, observed = sinks.write_observed_stage(_scored_documents(spark, sf), fresh_path(spark, "stage"), SENTIMENTS)
    row = merge.observed_audit_row(spark, observed, "chat sentiment", "predict", "documents")
    sinks.append(row, path)
    return spark.read.schema(row.schema).parquet(path)


@query("stage_run", "SELECT * FROM fact_v")
def stage_run(spark: SparkSession, sf: str) -> DataFrame:
    stage = fresh_path(spark, "stage")
    sinks.write_stage(sample.fact(spark, sf), stage)
    return files.read_stage(spark, stage)


@query(
    "fact_table",
    """SELECT * EXCLUDE (Negative, Neutral, Positive) REPLACE (CAST(UserID AS INT) AS UserID, CAST(round(DurationInMins, 2) AS DOUBLE) AS DurationInMins),
         CAST(round(Negative, 2) AS DOUBLE) AS Negative_Score, CAST(round(Neutral, 2) AS DOUBLE) AS Neutral_Score,
         CAST(round(Positive, 2) AS DOUBLE) AS Positive_Score
       FROM scored_v""",
)
def fact_table(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "fact-table")
    sinks.create_table(spark, path, FACT_TABLE)
    sinks.append(merge.to_fact_table(_scored(spark, sf)), path)
    scores = [F.col(f"{s}_Score").cast("double").alias(f"{s}_Score") for s in SENTIMENTS]
    stored = spark.read.schema(FACT_TABLE).parquet(path)
    kept = [c for c in stored.columns if c != "TransactionDate" and not c.endswith("_Score")]
    return stored.select(*kept, *scores).withColumn("DurationInMins", F.col("DurationInMins").cast("double"))


@query("export_messages", "SELECT Key, pos, user_type, text FROM turns_v")
def export_messages(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "messages-csv")
    messages = sample.turns(spark, sf).select("Key", "pos", "user_type", "text")
    sinks.write_csv(messages, path)
    return files.read_chat_export(spark, path, messages.schema)


@query("export_top_messages", TOP_SQL)
def export_top_messages(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "counts-csv")
    counts = tr.top_messages(_said(spark, sf), 1000)
    sinks.write_csv(counts, path)
    return files.read_chat_export(spark, path, counts.schema)


# --- search and details -------------------------------------------------------------------------

def _serving(spark: SparkSession, sf: str) -> DataFrame:
    """The scored chats as a stored serving table, which is what searches run on."""
    path = fresh_path(spark, "serving")
    sinks.write_serving(_scored(spark, sf), path)
    return files.read_table(spark, path, FACT)


SEARCH = filters.ChatFilter(search="th[aei]|les ")
HITS_SQL = "SELECT * FROM scored_v WHERE regexp_matches(html_text, 'th[aei]|les ')"


@query(
    "search",
    f"""SELECT substring(text, 1, 100) || '...' AS "Text", UserID AS "User ID", Date AS "Date",
          VIPLevel AS "VIP Level", round_even(DurationInMins, 0) AS "Duration (Mins)", Brand AS "Brand",
          CountryGroup1 AS "Country Group", ChatType AS "Chat Type", ChatID AS "Chat ID", AgentDisplayName AS "Agent",
          Sentiment AS "Sentiment"
        FROM ({HITS_SQL} ORDER BY Date, ChatID LIMIT 500)""",
)
def search_results(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_results(_serving(spark, sf), SEARCH, 500)


@query("search_count", f"SELECT count(*) AS hits FROM ({HITS_SQL})")
def search_count(spark: SparkSession, sf: str) -> DataFrame:
    return search.hit_count(_serving(spark, sf), SEARCH)


# Documents in the shape of facts: more hits than either limit keeps.
DOCUMENT_FACTS_SQL = """SELECT CAST(doc_id AS VARCHAR) AS ChatID, doc_id % 150 AS UserID,
  TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS Date, CAST(n_chars % 5 AS INT) AS VIPLevel,
  'not_rated' AS Rating, CAST(n_chars AS DOUBLE) / 60 AS DurationInMins, source AS Brand, lang AS CountryGroup1,
  'Support Chat' AS ChatType, source AS AgentDisplayName, text, text AS html_text, 'Neutral' AS Sentiment,
  CAST(0.25 AS DOUBLE) AS Negative, CAST(0.5 AS DOUBLE) AS Neutral, CAST(0.25 AS DOUBLE) AS Positive FROM documents"""
DOCUMENT_HITS_SQL = f"SELECT * FROM ({DOCUMENT_FACTS_SQL}) WHERE regexp_matches(html_text, 'th[aei]|les ')"


def _document_facts(spark: SparkSession, sf: str) -> DataFrame:
    minutes = F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    path = fresh_path(spark, "serving")
    facts = sample.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("ChatID"), (F.col("doc_id") % 150).alias("UserID"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + minutes).alias("Date"),
        (F.col("n_chars") % 5).cast("int").alias("VIPLevel"), F.lit("not_rated").alias("Rating"),
        (F.col("n_chars").cast("double") / 60).alias("DurationInMins"), F.col("source").alias("Brand"),
        F.col("lang").alias("CountryGroup1"), F.lit("Support Chat").alias("ChatType"),
        F.col("source").alias("AgentDisplayName"), "text", F.col("text").alias("html_text"),
        F.lit("Neutral").alias("Sentiment"), F.lit(0.25).alias("Negative"), F.lit(0.5).alias("Neutral"),
        F.lit(0.25).alias("Positive"),
    )
    sinks.write_serving(facts, path)
    return files.read_serving(spark, path)


@query(
    "search_documents",
    f"""SELECT substring(text, 1, 100) || '...' AS "Text", UserID AS "User ID", Date AS "Date",
          VIPLevel AS "VIP Level", round_even(DurationInMins, 0) AS "Duration (Mins)", Brand AS "Brand",
          CountryGroup1 AS "Country Group", ChatType AS "Chat Type", ChatID AS "Chat ID", AgentDisplayName AS "Agent",
          Sentiment AS "Sentiment"
        FROM ({DOCUMENT_HITS_SQL} ORDER BY Date, ChatID LIMIT 500)""",
)
def search_documents(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_results(_document_facts(spark, sf), SEARCH, 500)


def _indexed_documents(spark: SparkSession, sf: str) -> str:
    """The documents as an indexed table, in two loads."""
    facts, path = _document_facts(spark, sf), fresh_path(spark, "indexed")
    early = F.col("UserID") < 75
    for load in (facts.where(early), facts.where(~early)):
        text_index.append_indexed(load, path, block_rows=100)
    return path


@query(
    "indexed_search",
    f"""SELECT substring(text, 1, 100) || '...' AS "Text", UserID AS "User ID", Date AS "Date",
          VIPLevel AS "VIP Level", round_even(DurationInMins, 0) AS "Duration (Mins)", Brand AS "Brand",
          CountryGroup1 AS "Country Group", ChatType AS "Chat Type", ChatID AS "Chat ID", AgentDisplayName AS "Agent",
          Sentiment AS "Sentiment"
        FROM ({DOCUMENT_HITS_SQL} ORDER BY Date, ChatID LIMIT 500)""",
)
def indexed_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = text_index.candidates(spark, _indexed_documents(spark, sf), SEARCH)
    return search.search_results(rows, SEARCH, 500)


# Rare words, a flag, a class, an optional part; the last one has nothing that must occur.
INDEXED_PATTERNS = (r"AKIA[0-9A-Z]{4}", r"(?i)passw(or)?d|api_?key", "[Zz]ürich|Straße", r"[0-9]{3}-[0-9]{4}")


@query(
    "indexed_counts",
    " UNION ALL ".join(
        f"SELECT {literal(p)} AS pattern, count(*) AS hits, count(DISTINCT UserID) AS users FROM ({DOCUMENT_FACTS_SQL}) "
        f"WHERE regexp_matches(html_text, {literal(p)})"
        for p in INDEXED_PATTERNS
    ),
)
def indexed_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = _indexed_documents(spark, sf)
    counts = []
    for pattern in INDEXED_PATTERNS:
        chosen = filters.ChatFilter(search=pattern)
        hits = chosen.apply(text_index.candidates(spark, path, chosen))
        counts.append(hits.agg(F.lit(pattern).alias("pattern"), F.count("*").alias("hits"), F.count_distinct("UserID").alias("users")))
    return reduce(DataFrame.union, counts)


@query(
    "export_documents",
    f"SELECT * EXCLUDE (html_text) FROM ({DOCUMENT_HITS_SQL} ORDER BY Date, ChatID LIMIT 100)",
)
def export_documents(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "hits-csv")
    hits = search.export_hits(_document_facts(spark, sf), SEARCH, 100)
    sinks.write_csv(hits, path)
    return files.read_chat_export(spark, path, hits.schema)


EXPORTED = ("ChatID", "UserID", "VIPLevel", "Brand", "ChatType", "Sentiment", "text")


@query(
    "export_hits",
    f"SELECT {', '.join(EXPORTED)} FROM ({HITS_SQL} ORDER BY Date, ChatID LIMIT 100)",
)
def export_hits(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "hits-csv")
    hits = search.export_hits(_serving(spark, sf), SEARCH, 100)
    sinks.write_csv(hits, path)
    return files.read_chat_export(spark, path, hits.schema).select(*EXPORTED)


@query(
    "details",
    """SELECT ChatID, unnest(['User ID', 'VIP Level', 'Rating', 'Brand', 'Country Group', 'Chat Type', 'Chat ID',
           'Agent', 'Sentiment', 'Date', 'Duration (Mins)', 'Positive Score']) AS field,
         unnest([CAST(UserID AS VARCHAR), CAST(VIPLevel AS VARCHAR), Rating, Brand, CountryGroup1, ChatType, ChatID,
           AgentDisplayName, Sentiment, CAST(date_trunc('second', Date) AS VARCHAR), CAST(CAST(floor(DurationInMins) AS BIGINT) AS VARCHAR),
           CAST(UserID % 2 AS VARCHAR)]) AS value
       FROM fact_v""",
)
def details(spark: SparkSession, sf: str) -> DataFrame:
    facts = sample.fact(spark, sf).withColumns({
        "Date": F.date_trunc("second", F.col("Date")).cast("timestamp_ntz"),
        "DurationInMins": F.floor("DurationInMins"),
        "Positive": F.col("UserID") % 2,
    })
    return search.as_field_rows(facts)


@query("chat_by_id", "SELECT ChatID, html_text, Sentiment FROM scored_v WHERE ChatID = '7'")
def chat_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return search.chat_details(_serving(spark, sf), "7").select("ChatID", "html_text", "Sentiment")


@query(
    "random_chat",
    """SELECT ChatID, UserID FROM fact_v WHERE ChatType = 'Support Chat'
       ORDER BY md5(ChatID || 'seed 1'), ChatID LIMIT 1""",
)
def random_chat(spark: SparkSession, sf: str) -> DataFrame:
    return search.chat_details(sample.fact(spark, sf), seed="seed 1").select("ChatID", "UserID")


# --- streams ------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of files that follow no order of time, one to a micro-batch."""
    path = fresh_path(spark, "event-files")
    sample.table(spark, sf, "events").repartition(4, F.xxhash64("event_id")).write.parquet(path)
    return files.stream_table(spark, path, sample.TABLES["events"], max_files=1)


def _append_files(rows: DataFrame, number: str, path: str) -> None:
    """Add one file for each number, all by one pass over the rows; small row groups let several tasks read a file."""
    numbered = rows.repartition(number).write.mode("append").partitionBy(number)
    numbered.option("parquet.block.size", FILE_BLOCK).parquet(path)


@query("bucketed_merge", "SELECT * FROM fact_v")
def bucketed_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two loads into a table bucketed by the merge keys; the second repeats what the first brought."""
    table = f"bucketed_{uuid.uuid4().hex}"
    for facts in (_loaded(spark, sf), sample.fact(spark, sf)):
        load_bucketed_facts(facts, table, 8, check=False)
    return spark.table(table)


@query("stream_merge", "SELECT * FROM fact_v")
def stream_merge(spark: SparkSession, sf: str) -> DataFrame:
    table, profile = fresh_path(spark, "stream-fact"), sample.profile(spark, sf)
    loaded = _loaded(spark, sf)
    sinks.write_batch(loaded, table, -1)
    chats = sample.chats_of(_event_stream(spark, sf))
    started = loads.stream_merge(
        chats, lambda rows: sample.fact_of(rows, profile), table, fresh_path(spark, "stream-state")
    )
    started.awaitTermination()
    compacted = fresh_path(spark, "stream-fact")
    loads.compact_batches(spark, table, compacted, loaded.schema)
    return spark.read.parquet(compacted).select(*loaded.columns)


@query("stream_dedupe", "SELECT * FROM fact_v")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Four files in no order of time; the first and third again at the end. What was loaded before lies in the table."""
    table, profile = fresh_path(spark, "stream-days"), sample.profile(spark, sf)
    loaded, path = _loaded(spark, sf), fresh_path(spark, "event-files")
    loads.write_days(loaded, table, -1)
    events = sample.table(spark, sf, "events").withColumn("_file", F.pmod(F.xxhash64("event_id"), F.lit(4)))
    for delivery in ((0, 1, 2, 3), (0, 2)):
        _append_files(events.where(F.col("_file").isin(*delivery)), "_file", path)
    chats = sample.chats_of(files.stream_table(spark, path, sample.TABLES["events"], max_files=1))
    loads.stream_merge_by_day(
        chats, lambda rows: sample.fact_of(rows, profile), table, fresh_path(spark, "stream-state")
    ).awaitTermination()
    return spark.read.parquet(table).select(*loaded.columns)


@query("stream_hourly", f"SELECT {HOUR_SQL} AS Date, Sentiment, count(*) AS chats FROM fact_v GROUP BY 1, 2")
def stream_hourly(spark: SparkSession, sf: str) -> DataFrame:
    table = fresh_path(spark, "stream-hourly")
    facts = sample.moods(sample.chats_of(_event_stream(spark, sf)))
    started = hourly.start_hourly_counts(facts, table, fresh_path(spark, "stream-state"), "Sentiment")
    started.awaitTermination()
    compacted = fresh_path(spark, "stream-hourly")
    hourly.compact_hourly_counts(spark, table, compacted, "Sentiment")
    return hourly.read_hourly_counts(spark, compacted, "Sentiment")
