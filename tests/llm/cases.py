"""Rows that every operator must take: nulls, blanks, copies, odd characters, a long text, clashing columns."""

from pyspark.sql import types as T

CLASH = ["n_words", "print", "hits", "blob", "_row", "_key", "_hash", "_named", "_blob", "kept", "score", "at", "a.b"]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASH],
    ]
)

ENGLISH = "the quick brown fox jumps over the lazy dog and then it runs away from all the other animals near the river"
GERMAN = "der schnelle braune fuchs springt über den faulen hund und läuft dann weit weg von allen anderen tieren am fluss"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
TEXTS = [
    (1, ENGLISH, "en"),
    (2, GERMAN, "de"),
    (3, None, "en"),
    (4, "", None),
    (5, " \n\t ", "en"),
    (6, "12345 !!! ---", "de"),
    (7, ENGLISH.upper(), None),
    (8, ENGLISH, "en"),
    (8, ENGLISH, "en"),  # a repeated row
    (9, GERMAN + "\n" + GERMAN + "\n\nend", "de"),
    (None, ENGLISH + " once more", None),
    (None, None, None),
    (10, LONG, "en"),
    (11, "日本語 テキスト é́ İ 😀 <|endoftext|> </s> [INST]\x00\x1c", "ja"),
    (12, "word", "en"),
    (-5, "two  blanks\r\nand\tmore\xa0here.  ", "en"),
    (13, "yes yes yes yes yes yes", "en"),
]


def frame(spark, rows=None):
    rows = TEXTS if rows is None else rows
    full = [(i, t, lang, None if i is None else f"src{i % 3}", None if t is None else len(t), *["x"] * len(CLASH)) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
