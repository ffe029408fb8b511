"""The trigram index: what an expression requires, which blocks a search reads, and that no hit is lost."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palaver.operators.filters import ChatFilter
from palaver.operators.patterns import required, trigrams_of
from palaver.session import fresh_path
from palaver.sources import text_index
from test_clustered import rows_scanned
from test_filters import fact


@pytest.mark.parametrize(
    "pattern, need",
    [
        ("hello", ("and", "hel", "ell", "llo")),
        ("HeL", "hel"),
        ("abc|xyz", ("or", "abc", "xyz")),
        ("abc|x", None),
        ("th[aei]", ("or", "tha", "the", "thi")),
        ("th[aei]|les ", ("or", ("and", "les", "es "), "tha", "the", "thi")),
        ("a[0-9]+bcd.*efg", ("and", "bcd", "efg")),
        ("(abc)+", "abc"),
        ("(abc)*", None),
        ("ab?cd", ("or", ("and", "abc", "bcd"), "acd")),
        ("(ab){2}", ("and", "aba", "bab")),
        ("^abc$", "abc"),
        ("(?i)ABC", "abc"),
        ("x(?=abc)yzw", "yzw"),
        ("[^a]bcd", "bcd"),
        ("ab.cd", None),
        ("", None),
        # read otherwise by the two engines, or by one alone: nothing is required
        (r"\Qa.b\E", None),
        ("[a-z&&[aeiou]]bcd", None),
        (r"abc\v", None),
        ("(?iu)abc", None),
        ("(?x)a b c", None),
        (r"\p{L}abc", None),
        ("(?<name>abc)", None),
        ("abc(", None),
        ("😀ab", "😀ab"),
        (r"\ud83d\ude00ab", None),
    ],
)
def test_what_an_expression_requires(pattern, need):
    assert required(pattern) == need or sorted(map(str, required(pattern))) == sorted(map(str, need))


def test_required_trigrams_are_in_every_match():
    """Random expressions over few letters against random texts: a match without its trigrams would be a lost hit."""
    rng = random.Random(7)

    def made(depth):
        kind = rng.randrange(7) if depth else 0
        if kind <= 1:
            return "".join(rng.choice("abC") for _ in range(rng.randrange(1, 5)))
        if kind == 2:
            return f"({made(depth - 1)}|{made(depth - 1)})"
        if kind == 3:
            return f"({made(depth - 1)}){rng.choice(['?', '*', '+', '{2}', '{1,2}'])}"
        if kind == 4:
            return "[" + rng.choice(["ab", "a-c", "^a", "bC"]) + "]"
        if kind == 5:
            return "."
        return made(depth - 1) + made(depth - 1)

    def meets(need, there):
        if isinstance(need, tuple):
            return (all if need[0] == "and" else any)(meets(part, there) for part in need[1:])
        return need is None or need in there

    told = 0
    for _ in range(600):
        pattern = made(4)
        need = required(pattern)
        told += need is not None
        for _ in range(40):
            text = "".join(rng.choice("abC") for _ in range(rng.randrange(12)))
            if re.search(pattern, text):
                folded = text.lower()
                assert meets(need, {folded[i : i + 3] for i in range(len(folded) - 2)}), (pattern, text)
    assert told > 100


TEXTS = ["the cat sat", "a dog ran", None, "", "ab", "ÄÖÜ straße 日本語", "line\nbreak\nhere", "😀😀😀 smile", "The End", "zebra crossing"]


def stored(spark, texts, column="html_text"):
    start = datetime(2024, 1, 1)
    return fact(spark, *({column: t, "Date": start + timedelta(hours=n)} for n, t in enumerate(texts)))


def test_trigrams_of_texts(spark, monkeypatch):
    rows = stored(spark, TEXTS).withColumn("block", F.lit(0))
    expected = {t.translate({c: c + 32 for c in range(65, 91)})[i : i + 3] for t in TEXTS if t for i in range(len(t) - 2)}
    expected = {t.translate({c: c + 32 for c in range(65, 91)}) for t in expected}
    got = {r.trigram for r in text_index.trigrams(rows, "html_text").collect()}
    assert expected <= got and all(len(t) == 3 for t in got)
    monkeypatch.setattr(text_index, "PIECE", 4)
    assert {r.trigram for r in text_index.trigrams(rows, "html_text").collect()} >= expected


@pytest.mark.parametrize("pattern", ["cat|dog", "(?i)the", "straße", "break\nhere", "😀 s", "ab", "[a-c]at", "nothing here", "sm.le$", "日本"])
def test_search_over_the_index_finds_every_hit(spark, pattern):
    path = fresh_path(spark, "indexed")
    facts = stored(spark, TEXTS)
    text_index.append_indexed(facts.where("Date < '2024-01-01 05:00:00'"), path, block_rows=2)
    text_index.append_indexed(facts.where("Date >= '2024-01-01 05:00:00'"), path, block_rows=2)
    chosen = ChatFilter(search=pattern)
    found = chosen.apply(text_index.candidates(spark, path, chosen))
    assert sorted(r.ChatID for r in found.collect()) == sorted(r.ChatID for r in chosen.apply(facts).collect())
    assert found.columns == facts.columns


def test_search_reads_the_blocks_that_may_hold_hits(spark, monkeypatch):
    monkeypatch.setattr(text_index, "FOLDER_BLOCKS", 4)
    path = fresh_path(spark, "indexed")
    texts = [f"common words and word{n:04d}" for n in range(2000)]
    text_index.append_indexed(stored(spark, texts), path, block_rows=100)
    every = text_index.read_indexed(spark, path)
    assert every.count() == 2000 and 15 <= every.select("block").distinct().count() <= 25
    order = [r.ChatID for r in every.orderBy("block", "Date").collect()]
    assert order == [str(n) for n in range(2000)]  # blocks follow each other in time

    def read(pattern, **more):
        rows = text_index.candidates(spark, path, ChatFilter(search=pattern, **more))
        return rows_scanned(rows), rows.select(F.input_file_name().alias("f")).distinct().count(), rows

    scanned, files, rows = read("word1234")
    assert scanned <= 220 and files == 1  # a block, or two, of one folder
    assert "PartitionFilters: []" not in rows._jdf.queryExecution().executedPlan().toString()
    scanned, files, rows = read("word1[0-2]34|word0071")
    assert scanned <= 900 and files <= 4
    assert read("absent from all")[0] == 0
    assert read("[0-9]{3}")[0] == read("word1234", search_column="text")[0] == 2000
    monkeypatch.setattr(text_index, "MOST_RANGES", 0)  # the join in place of the ranges
    chosen = ChatFilter(search="word1234")
    joined = text_index.candidates(spark, path, chosen)
    assert joined.count() <= 220 and [r.html_text for r in chosen.apply(joined).collect()] == [texts[1234]]


@pytest.mark.parametrize("ranges", [0, 1000])
def test_folders_without_index_are_read_in_any_case(spark, monkeypatch, ranges):
    monkeypatch.setattr(text_index, "MOST_RANGES", ranges)
    path = fresh_path(spark, "indexed")
    facts = stored(spark, ["first cat", "second dog", "third dog"])
    text_index.append_indexed(facts.where("ChatID = '0'"), path)
    # a load that broke off before its index was written
    broken = facts.where("ChatID = '1'").withColumns({"block": F.lit(64).cast("long"), "folder": F.lit(1)})
    broken.write.mode("append").partitionBy("folder").parquet(f"{path}/rows")
    text_index.append_indexed(facts.where("ChatID = '2'"), path)
    for search, hits in (("dog", ["1", "2"]), ("cat", ["0"]), ("nothing", [])):
        chosen = ChatFilter(search=search)
        assert sorted(r.ChatID for r in chosen.apply(text_index.candidates(spark, path, chosen)).collect()) == hits
    assert text_index._stored_folders(spark, path) == [0, 1, 2]


def test_an_empty_table_is_searched(spark):
    path = fresh_path(spark, "indexed")
    text_index.append_indexed(stored(spark, ["x"]).limit(0), path)
    assert text_index.candidates(spark, path, ChatFilter(search="abc")).count() == 0
    assert trigrams_of(None) == []
