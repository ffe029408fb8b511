"""Transcripts: parsing, exploding, HTML, visitor text, canned phrases.

A parsed transcript is an array of messages. Whatever concerns one chat (HTML, visitor text)
stays in that array: one narrow stage, no shuffle, order kept. The exploded form is for
questions across chats and for phrase lists too long to inline.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Collection, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import html_message
from palaver.schemas import MESSAGE, TRANSCRIPT
from palaver.session import fresh_path

MAX_INLINE_PHRASES = 5_000
MAX_PHRASE_BYTES = 4_096


def complete_transcripts(df: DataFrame, column: str = "Messages") -> DataFrame:
    """Chats whose transcript string was not cut off; null and empty transcripts go too."""
    return df.where(F.col(column).endswith("}]"))


def _read_literal(literal: str | None) -> list[dict] | None:
    """The messages of a Python literal, or None if it is no list of messages."""
    if literal is None:
        return None
    try:
        found = ast.literal_eval(literal)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None
    if not isinstance(found, list):
        return None
    try:
        return [_message(m) for m in found]
    except TypeError:  # a value that has no JSON form, such as bytes
        return None


def _message(fields: object) -> dict[str, str | None] | None:
    if not isinstance(fields, dict):
        return None
    return {n: v if v is None or isinstance(v, str) else json.dumps(v) for n in MESSAGE.names for v in [fields.get(n)]}


# The batch function returns the messages themselves. It is declared nondeterministic so that
# filters on the result are not pushed below it, which would run it twice; filters on other
# columns belong in `where`, which is applied before anything is parsed.
@F.pandas_udf(TRANSCRIPT)
def _read_literals(literals: pd.Series) -> pd.Series:
    return pd.Series([_read_literal(x) for x in literals], dtype="object")


_parsed_literal = _read_literals.asNondeterministic()


# The lexer of literals. Escaped backslashes and quotes are set aside under marks first, so that a
# quoted run ends at the next quote of its kind.
BACKSLASH_MARK, SINGLE_MARK, DOUBLE_MARK = "\ue000", "\ue001", "\ue002"
TOKENS = r"""'[^']*'|"[^"]*"|[^'"]+"""
# Escapes that are left then and mean the same in both notations, or have a JSON form.
ESCAPES = r"\\(?![nrtbfav]|x[0-9a-fA-F]{2}|u(?![dD][89a-fA-F])[0-9a-fA-F]{4})"
CONTROLS = "[\\x00-\\x08\\x0a-\\x1f]"  # without the tab
# Between quoted runs: names of constants and whole numbers, and around them brackets, blanks, commas, colons.
CONSTANTS = r"(?:\b(?:None|True|False|0|[1-9][0-9]*)|-[1-9][0-9]*)\b"
BETWEEN = r"^[\[\]{}:, \t\r\n]*$"


def _quoted_as_json(token: Column) -> Column:
    """A quoted run as a JSON string."""
    inner = token.substr(F.lit(2), F.length(token) - 2)
    inner = F.replace(F.replace(inner, F.lit('"'), F.lit('\\"')), F.lit("\t"), F.lit("\\t"))
    inner = F.regexp_replace(inner, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    inner = F.replace(F.replace(inner, F.lit("\\a"), F.lit("\\u0007")), F.lit("\\v"), F.lit("\\u000b"))
    for mark, text in ((SINGLE_MARK, "'"), (DOUBLE_MARK, '\\"'), (BACKSLASH_MARK, "\\\\")):
        inner = F.replace(inner, F.lit(mark), F.lit(text))
    return F.concat(F.lit('"'), inner, F.lit('"'))


def _between_as_json(token: Column) -> Column:
    for name, value in (("None", "null"), ("True", "true"), ("False", "false")):
        token = F.replace(token, F.lit(name), F.lit(value))
    return token


def literals_as_json(df: DataFrame, column: str, into: str) -> DataFrame:
    """Add `into`: a list of dictionaries in Python's notation as JSON, by built-in expressions alone.

    Null for any other string, and for what is written otherwise than `repr` writes it: nested
    lists or dictionaries, numbers with a fraction, other escapes, prefixes, tuples. Quoted runs
    keep every character.
    """
    # Strings that hold a mark of their own could not be told apart.
    raw = F.when(~F.col(column).rlike(f"[{BACKSLASH_MARK}{SINGLE_MARK}{DOUBLE_MARK}]"), F.col(column))
    marked = F.replace(raw, F.lit("\\\\"), F.lit(BACKSLASH_MARK))
    marked = F.replace(F.replace(marked, F.lit("\\'"), F.lit(SINGLE_MARK)), F.lit('\\"'), F.lit(DOUBLE_MARK))
    is_quoted = lambda t: t.substr(1, 1).isin("'", '"')
    between = F.array_join(F.filter("_tokens", lambda t: ~is_quoted(t)), " ")
    quoted = F.array_join(F.filter("_tokens", is_quoted), "")
    brackets = F.regexp_replace("_between", r"[^\[\]{}]", "")
    readable = (
        (F.aggregate("_tokens", F.lit(0), lambda n, t: n + F.length(t)) == F.length("_marked"))  # every quote is closed
        & F.regexp_replace("_between", CONSTANTS, "").rlike(BETWEEN)
        & (F.replace(brackets, F.lit("{}"), F.lit("")) == "[]") & brackets.startswith("[")
        & ~F.col("_quoted").rlike(ESCAPES) & ~F.col("_quoted").rlike(CONTROLS)
    )
    return (
        df.withColumn("_marked", marked)
        .withColumn("_tokens", F.regexp_extract_all("_marked", F.lit(TOKENS), F.lit(0)))
        .withColumn("_between", between).withColumn("_quoted", quoted)
        .withColumn(into, F.when(readable, F.array_join(
            F.transform("_tokens", lambda t: F.when(is_quoted(t), _quoted_as_json(t)).otherwise(_between_as_json(t))), ""
        )))
        .drop("_marked", "_tokens", "_between", "_quoted")
    )


def _once(column: Column) -> Column:
    """The column, pinned where it stands.

    A filter on what is parsed from it would otherwise be pushed below the parse and parse a second
    time. The condition always holds, but being nondeterministic it stays where it is.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def parse_transcripts(
    df: DataFrame,
    column: str = "Messages",
    into: str = "transcript",
    dialect: str = "auto",
    where: Column | None = None,
) -> DataFrame:
    """Add the parsed transcript; it is null where the string cannot be parsed.

    `dialect="json"` reads JSON, also with single quotes. `"native"` reads Python literals as well,
    as far as the lexer of `literals_as_json` takes them: a string that looks like one is turned
    into JSON, and all are parsed in one pass, without Python. `"auto"` hands what that leaves null
    to Python as a last resort; only those strings travel to the workers. `literal_census` counts
    them. `where` picks rows by their other columns before the parse and reaches the scan; a filter
    on the result of this function does not.
    """
    if where is not None:
        df = df.where(where)
    if into.lower() == column.lower():
        raise ValueError("the parsed column needs a name of its own, letter case aside")
    if dialect == "json":
        return df.withColumn(into, F.from_json(_once(F.col(column)), TRANSCRIPT))
    if dialect not in ("auto", "native"):
        raise ValueError(f"unknown dialect {dialect!r}")
    # JSON proper needs no lexer: its first quote is a double one and it has none of the constants.
    literal = F.col(column).rlike(r"^[\s\[{]*'") | F.col(column).contains("None") | F.col(column).contains("True") | F.col(column).contains("False")
    lexed = literals_as_json(df.withColumn("_literal", F.when(literal, F.col(column))), "_literal", "_lexed")
    parsed = lexed.withColumn(into, F.from_json(_once(F.coalesce("_lexed", F.col(column))), TRANSCRIPT)).drop("_literal", "_lexed")
    if dialect == "native":
        return parsed
    left_over = F.when(F.col(into).isNull(), F.col(column))
    return (
        parsed.withColumn("_literal", _parsed_literal(left_over)).withColumn(into, F.coalesce(F.col(into), F.col("_literal"))).drop("_literal")
    )


def literal_census(df: DataFrame, column: str = "Messages") -> DataFrame:
    """(read, transcripts): how many complete transcripts are read natively, how many need Python, how many neither reads."""
    complete = complete_transcripts(df, column).select(column)
    native = parse_transcripts(complete, column, "_native", "native")
    rest = F.when(F.col("_native").isNull(), F.col(column))
    told = native.withColumn("_python", _parsed_literal(rest)).select(
        F.when(F.col("_native").isNotNull(), "native").when(F.col("_python").isNotNull(), "python").otherwise("unreadable").alias("read")
    )
    return told.groupBy("read").agg(F.count("*").alias("transcripts"))


def parsed_and_quarantined(df: DataFrame, column: str = "transcript") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(column).isNotNull()), df.where(F.col(column).isNull())


def explode_messages(df: DataFrame, key: str = "ID", column: str = "transcript") -> DataFrame:
    """One row per message: `Key`, its place, the message fields."""
    return df.select(F.col(key).alias("Key"), F.posexplode(column).alias("pos", "m")).select("Key", "pos", "m.*")


def html_transcript(messages: Column, mask: bool = False, escape: bool = False) -> Column:
    return F.array_join(F.transform(messages, lambda m: html_message(m, mask, escape)), "")


def _listed(text: Column, phrases: Collection[str]) -> Column:
    if phrases is None:  # the answer of `inline_phrases` to a long list, which would pass for an empty one
        raise TypeError("a phrase list too long for an expression is joined: with_visitor_text")
    # `isin` becomes one hash-set probe; a null text is in no list.
    return F.coalesce(text.isin(list(phrases)), F.lit(False)) if phrases else F.lit(False)


def visitor_messages(messages: Column, phrases: Collection[str] = ()) -> Column:
    """The visitor's messages, without those that equal a listed phrase (case and blanks count)."""
    return F.filter(messages, lambda m: (m["user_type"] == "visitor") & ~_listed(m["text"], phrases))


def joined_texts(messages: Column, separator: str = ",") -> Column:
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["text"], F.lit(""))), separator)


def inline_phrases(
    phrases: DataFrame, column: str = "FilterMessages", most: int = MAX_INLINE_PHRASES
) -> tuple[str, ...] | None:
    """The phrase list as values if it is short enough to be part of an expression, else None.

    Both the number of rows fetched and the bytes of each are bounded. Either way a chat keeps the
    same texts: the bound only decides where the list is looked up.
    """
    short = F.when(F.octet_length(column) <= MAX_PHRASE_BYTES, F.col(column))
    rows = phrases.where(F.col(column).isNotNull()).select(short).limit(most + 1).collect()
    values = {row[0] for row in rows}
    if len(rows) > most or None in values:
        return None
    return tuple(sorted(values))


def drop_listed(
    messages: DataFrame, phrases: DataFrame, text: str = "text", column: str = "FilterMessages"
) -> DataFrame:
    """Messages that equal no listed phrase: an anti join for phrase lists of any length.

    A short list is broadcast from its known size. Beyond that one canned answer may be a third of
    all messages: AQE splits its partition, as the left side of an anti join may be split.
    """
    listed = phrases.select(F.col(column).alias(text)).distinct()
    return messages.join(listed, text, "left_anti").select(*messages.columns)


def ordered_concat(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    separator: str = "",
    span: int = 512,
) -> DataFrame:
    """One row per key: the values in order, joined. A null value counts as empty.

    Runs of `span` positions are joined first, so the rows of one long chat are sorted and joined
    in many tasks and only its finished pieces meet.
    """

    def join_sorted(place: str, part: str) -> Column:
        entries = F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), F.col(part).alias("part"))))
        return F.array_join(F.transform(entries, lambda e: F.coalesce(e["part"], F.lit(""))), separator)

    rows = df.select(*keys, F.col(order), F.col(value))
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    pieces = rows.groupBy(*keys, F.floor(F.col(order) / span).alias("_run")).agg(
        join_sorted(order, value).alias("_piece")
    )
    return pieces.groupBy(*keys).agg(join_sorted("_run", "_piece").alias(value))


def html_by_key(messages: DataFrame, mask: bool = False, escape: bool = False) -> DataFrame:
    """(Key, html_text) from exploded messages."""
    fields = F.struct(*[F.col(f) for f in MESSAGE.names if f in messages.columns])
    rows = messages.select("Key", "pos", html_message(fields, mask, escape).alias("html_text"))
    return ordered_concat(rows, ["Key"], "pos", "html_text")


def visitor_text_by_key(messages: DataFrame, phrases: DataFrame) -> DataFrame:
    """(Key, text) from exploded messages: chats with nothing but listed phrases have no row."""
    spoken = messages.where(F.col("user_type") == "visitor").select("Key", "pos", "text")
    return ordered_concat(drop_listed(spoken, phrases), ["Key"], "pos", "text", separator=",")


def top_messages(messages: DataFrame, n: int = 1000) -> DataFrame:
    """The n most frequent texts, with counts."""
    counts = messages.where(F.col("text").isNotNull()).groupBy("text").agg(F.count("*").alias("messages"))
    return counts.orderBy(F.desc("messages"), "text").limit(n)


def with_visitor_text(chats: DataFrame, phrases: DataFrame, most: int = MAX_INLINE_PHRASES) -> DataFrame:
    """Add `text` to chats with a `_visitor` array; chats left without a message have a null text.

    A phrase list that is too long for an expression is met by an anti join. Each chat is then a
    row of a stored table under a number of its own: texts find back to their row, whatever its
    ID says, and nothing is parsed twice.
    """
    listed = inline_phrases(phrases, most=most)
    if listed is not None:
        kept = F.filter("_visitor", lambda m: ~_listed(m["text"], listed))
        chats = chats.withColumn("_kept", kept)
        return chats.withColumn("text", F.when(F.size("_kept") > 0, joined_texts(F.col("_kept")))).drop("_kept", "_visitor")
    numbered = chats.withColumn("_chat", F.monotonically_increasing_id())
    path = fresh_path(chats.sparkSession, "visitor-texts")
    numbered.write.parquet(path)
    stored = chats.sparkSession.read.schema(numbered.schema).parquet(path)
    texts = visitor_text_by_key(explode_messages(stored, "_chat", "_visitor"), phrases)
    return stored.drop("_visitor").join(texts.withColumnRenamed("Key", "_chat"), "_chat", "left").drop("_chat")


def shape_chats(
    chats: DataFrame,
    phrases: DataFrame,
    mask: bool = False,
    escape: bool = False,
    dialect: str = "auto",
    where: Column | None = None,
    most_inline: int = MAX_INLINE_PHRASES,
    unreadable: str | None = None,
) -> DataFrame:
    """Add `text` and `html_text` to chats with a `Messages` string, and drop the rest of it.

    A chat disappears if its transcript is cut off or unreadable, or if its visitor wrote nothing
    but listed phrases. `mask` hides personal data in `html_text`; `text` stays as written, for
    scoring. `where` picks chats by their other columns before the parse. Phrase lists of more
    than `most_inline` phrases are joined, with the same result. With `unreadable`, chats whose
    transcript is whole but cannot be read stay, without text, and a column of that name holds
    their transcript; it is null for the others. So one parse serves both.
    """
    parsed = parse_transcripts(complete_transcripts(chats), dialect=dialect, where=where)
    others = [F.col(f"`{c}`") for c in chats.columns if c != "Messages"]
    if unreadable is not None:
        others.append(F.when(F.col("transcript").isNull(), F.col("Messages")).alias(unreadable))
    html = html_transcript(F.col("transcript"), mask, escape).alias("html_text")
    spoken = parsed.select(*others, html, visitor_messages(F.col("transcript")).alias("_visitor"))
    shaped = with_visitor_text(spoken, phrases, most_inline)
    kept = F.col("text").isNotNull()
    if unreadable is not None:
        kept = kept | F.col(unreadable).isNotNull()
        others[-1] = F.col(unreadable)
    return shaped.where(kept).select(*others, "text", "html_text")


def transcript_census(
    chats: DataFrame, phrases: DataFrame, dialect: str = "auto", most_inline: int = MAX_INLINE_PHRASES
) -> DataFrame:
    """(outcome, chats): how many chats shaping keeps, and why it drops the others.

    Cut-off transcripts are told by their ending and not parsed.
    """
    complete = F.coalesce(F.col("Messages").endswith("}]"), F.lit(False))
    whole = chats.select(complete.alias("_complete"), F.when(complete, F.col("Messages")).alias("Messages"))
    parsed = parse_transcripts(whole, dialect=dialect)
    spoken = parsed.select(
        "_complete",
        F.col("transcript").isNotNull().alias("_readable"),
        visitor_messages(F.col("transcript")).alias("_visitor"),
    )
    told = with_visitor_text(spoken, phrases, most_inline)
    outcome = (
        F.when(~F.col("_complete"), "cut off")
        .when(~F.col("_readable"), "unreadable")
        .when(F.col("text").isNotNull(), "kept")
        .otherwise("only listed phrases")
    )
    return told.select(outcome.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("chats"))
