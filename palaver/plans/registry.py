"""Registered queries, each with the SQL that gives the same rows on the sample tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from palaver.functions import text as patterns
from palaver.operators.scoring import Lexicon
from palaver.schemas import EMAIL_MASK, PHONE_MASK, URL_MASK

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` may use the views of `VIEWS`, which are put in front as CTEs."""

    def register(run: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Entry(run, with_views(sql) if sql else None)
        return run

    return register


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def mask_sql(text: str) -> str:
    for pattern, mask in (
        (patterns.EMAIL_PATTERN, EMAIL_MASK),
        (patterns.PHONE_PATTERN, PHONE_MASK),
        (patterns.URL_PATTERN, URL_MASK),
    ):
        text = f"regexp_replace({text}, {literal(pattern)}, {literal(mask)}, 'g')"
    return text


def round_hour_sql(ts: str) -> str:
    into = f"(epoch_us({ts}) % 3600000000)"
    return (
        f"(date_trunc('hour', {ts}) + CASE WHEN {into} > 1800000000 OR ({into} = 1800000000 "
        f"AND hour({ts}) % 2 = 1) THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END)"
    )


def hits_sql(text: str, words: tuple[str, ...]) -> str:
    """How often the words occur. Every word gets two blanks around it, so neighbours both match."""
    spaced = f"' ' || regexp_replace(lower({text}), '[^a-z]+', '  ', 'g') || ' '"
    listed = "|".join(words)
    return f"CAST(len(regexp_extract_all({spaced}, {literal(f' ({listed}) ')})) AS DOUBLE)"


def scores_sql(source: str, text: str) -> str:
    """All columns of `source` plus class scores and label of the default lexicon."""
    words = Lexicon()
    return f"""
      SELECT * EXCLUDE (neg, neu, pos, top, total),
        exp(neg - top) / total AS Negative, exp(neu - top) / total AS Neutral, exp(pos - top) / total AS Positive,
        CASE WHEN neg >= neu AND neg >= pos THEN 'Negative' WHEN neu >= pos THEN 'Neutral' ELSE 'Positive' END
          AS Sentiment
      FROM (SELECT *, exp(neg - top) + exp(neu - top) + exp(pos - top) AS total
        FROM (SELECT *, greatest(neg, neu, pos) AS top
          FROM (SELECT *, {hits_sql(text, words.negative)} AS neg, CAST({words.neutral_logit} AS DOUBLE) AS neu,
                  {hits_sql(text, words.positive)} AS pos FROM {source})))"""


HTML_SQL = "'<b>' || {author} || ' (' || user_type || ') on ' || date || '</b><br>' || {text} || '<br><br>'"

# Views over the sample tables, in an order in which each needs only earlier ones.
VIEWS = {
    "profile_v": """
      SELECT c_custkey AS UserID, CAST(floor(c_acctbal / 2000) AS INT) AS VIPlevelNo,
        c_mktsegment AS BrandFriendlyName, r_name AS CountryGroup1
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      WHERE c_acctbal > 0""",
    "chats_v": """
      SELECT CAST(event_id AS VARCHAR) AS ID, user_id AS UserID,
        CASE event_type WHEN 'purchase' THEN 'rated_good' WHEN 'error' THEN 'rated_bad' ELSE 'not_rated' END AS rate,
        CAST(round(value * 60) AS BIGINT) AS duration, ts AS started,
        CASE event_type WHEN 'error' THEN 'ChatBot,auto' WHEN 'signup' THEN NULL ELSE 'support' END AS tags,
        'Agent ' || CAST(hour(ts) // 4 AS VARCHAR) AS agent,
        CAST(regexp_extract(props, '[0-9]+') AS INT) AS mood
      FROM events""",
    "joined_v": """
      SELECT ID, ch.UserID AS UserID, VIPlevelNo AS VIPLevel, rate AS Rating,
        CAST(duration AS DOUBLE) / 60 AS DurationInMins, BrandFriendlyName AS Brand, CountryGroup1, started AS Date,
        CASE WHEN tags ILIKE '%chatbot%' THEN 'Chatbot Chat' ELSE 'Support Chat' END AS ChatType,
        agent AS AgentDisplayName, mood
      FROM chats_v ch LEFT JOIN profile_v p ON p.UserID = ch.UserID""",
    "fact_v": """
      SELECT ID AS ChatID, UserID, Date, COALESCE(VIPLevel, 0) AS VIPLevel, Rating, DurationInMins,
        COALESCE(Brand, '') AS Brand, COALESCE(CountryGroup1, '') AS CountryGroup1, ChatType, AgentDisplayName,
        CASE WHEN mood <= 33 THEN 'Negative' WHEN mood <= 66 THEN 'Neutral' ELSE 'Positive' END AS Sentiment
      FROM joined_v""",
    "turns_v": """
      SELECT CAST(conv_id AS VARCHAR) AS Key, turn AS pos, role || CAST(conv_id AS VARCHAR) AS author_name,
        CASE role WHEN 'user' THEN 'visitor' WHEN 'assistant' THEN 'agent' ELSE 'supervisor' END AS user_type,
        '2024-01-01 00:' || lpad(CAST(turn AS VARCHAR), 2, '0') AS date, text
      FROM conversations""",
    "phrases_v": "SELECT DISTINCT text AS FilterMessages FROM conversations WHERE length(text) < 50",
    "html_v": f"""
      SELECT Key, string_agg({HTML_SQL.format(author="author_name", text="text")}, '' ORDER BY pos) AS html_text
      FROM turns_v GROUP BY Key""",
    "masked_html_v": f"""
      SELECT Key, string_agg({HTML_SQL.format(author=mask_sql("author_name"), text=mask_sql("text"))}, ''
        ORDER BY pos) AS html_text
      FROM turns_v GROUP BY Key""",
    "visitor_v": """
      SELECT Key, string_agg(text, ',' ORDER BY pos) AS text FROM turns_v
      WHERE user_type = 'visitor' AND NOT EXISTS (SELECT 1 FROM phrases_v WHERE FilterMessages = text)
      GROUP BY Key""",
    "shaped_v": """
      SELECT j.*, v.text AS text, h.html_text AS html_text
      FROM joined_v j JOIN visitor_v v ON v.Key = j.ID LEFT JOIN masked_html_v h ON h.Key = j.ID""",
    "scored_v": f"""
      SELECT {mask_sql("text")} AS text, UserID, Date, COALESCE(VIPLevel, 0) AS VIPLevel, Rating, DurationInMins,
        COALESCE(Brand, '') AS Brand, COALESCE(CountryGroup1, '') AS CountryGroup1, ChatType, ID AS ChatID,
        AgentDisplayName, html_text, Negative, Neutral, Positive, Sentiment
      FROM ({scores_sql("shaped_v", "text")})""",
}


def _needs(sql: str) -> set[str]:
    needed: set[str] = set()
    for name in VIEWS:
        if name in sql:
            needed |= {name} | _needs(VIEWS[name])
    return needed


def with_views(sql: str) -> str:
    """The query with every view it uses in front; its own WITH clause, if any, is continued."""
    sql, needed = sql.strip(), _needs(sql)
    if not needed:
        return sql
    views = ", ".join(f"{name} AS ({text})" for name, text in VIEWS.items() if name in needed)
    return f"WITH {views}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {views} {sql}"
