"""Benchmark decontamination with DataFrame functions only.

Benchmark texts are cut into windows of ten normalised words (a shorter item is one window); the
hashes of the distinct windows are broadcast. The windows of every training text are hashed and
looked up while the text streams by; a hit is verified word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import all_of, settled, spare

WINDOW = 10
BLOCK_BYTES = 64 << 20  # benchmark windows broadcast at a time; a larger set is looked up in blocks
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"  # fixed value; after lower-casing A-Z


def words(text: str | Column) -> Column:
    """Normalised words of a text; null has none."""
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS + "+")
    return F.array_remove(cut, "")


def _hashes(size: int) -> Column:
    """Hash of every window of `size` words, in order; empty for a shorter text."""
    # Word by word: a slice would copy the whole array for each window. The chain of hashes is that of an array.
    last = F.greatest(F.col("_n") - size, F.lit(0))
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get("_words", i + j) for j in range(size))))
    return F.when(F.col("_n") >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows: window (its words), hash, items (ids as text, sorted). Items without words have none."""
    cut = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("_words"))
    cut = cut.withColumn("_n", F.size("_words")).filter("_n > 0")
    length = F.least(F.col("_n"), F.lit(size))
    at = cut.select("item", "_words", length.alias("k"), F.explode(F.sequence(F.lit(1), F.col("_n") - length + 1)).alias("at"))
    window = at.select("item", F.slice("_words", F.col("at"), F.col("k")).alias("window"))
    grouped = window.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return grouped.select("window", F.xxhash64("window").alias("hash"), "items")


def find(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    size: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of `docs`: key, `text_hash`, n_words, hits and items.

    `hits` are (at, k): first word and length of every occurring window, in order; `items` the ids
    of the items they come from, sorted as text. A null text has no words; an item without words
    has no windows, one with a null id marks words but is not listed. Repeated rows stay, as often
    as they come; empty tables give no rows or no hits; other columns are not read.

    Texts are read once for each `block_bytes` of benchmark windows, so what is broadcast is bounded.
    """
    windows = settled(benchmark_windows(benchmark, item, text, size), "benchmark-windows")
    weight = F.sum(F.lit(64) + F.length(F.concat_ws(" ", "window")) + F.length(F.concat_ws(",", "items")))
    bound = windows.agg(weight.alias("bytes"), F.sort_array(F.collect_set(F.size("window"))).alias("sizes")).first()
    blocks, sizes = max(1, -(-(bound.bytes or 0) // block_bytes)), bound.sizes or [size]

    cut = docs.select(F.col(key), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("_words"))
    cut = cut.withColumn("_n", F.size("_words"))
    # Every text sends one marker through the join, so texts without hits stay; it matches a row of the first block.
    marker, marked = F.lit(0).cast("bigint"), docs.sparkSession.range(1).select(
        F.array().cast("array<string>").alias("window"), F.col("id").alias("hash"), F.array().cast("array<string>").alias("items")
    )
    hashed = cut.select("*", F.concat(F.array(marker), *(_hashes(k) for k in sizes)).alias("_hashes"))
    # The outer form, as the plain one first filters on the array's size, which would hash every text twice.
    exploded = hashed.select(key, "text_hash", "_words", "_n", F.posexplode_outer("_hashes").alias("_index", "hash"))

    k = F.size("window")
    before = reduce(lambda a, b: a + b, (F.when(k > s, F.greatest(F.col("_n") - s + 1, F.lit(0))).otherwise(0) for s in sizes))
    at = F.when(k == 0, -1).otherwise(F.col("_index") - 1 - before)
    met = []
    for block in range(blocks):
        some = windows.filter(F.pmod("hash", F.lit(blocks)) == block)
        some = some.union(marked) if block == 0 else some
        joined = exploded.join(F.broadcast(some), "hash").withColumn("_at", at)
        real = (F.col("_at") >= 0) & (F.col("_at") + k <= F.col("_n"))
        same = F.slice("_words", F.greatest(F.col("_at"), F.lit(0)) + 1, k) == F.col("window")
        true_marker = (k == 0) & (F.col("_index") == 0)
        met.append(
            joined.filter(true_marker | ((k > 0) & real & same))
            .select(key, "text_hash", F.col("_n").cast("long").alias("n_words"), "_at", k.cast("int").alias("_k"), "items")
        )
    rows = reduce(DataFrame.union, met)
    hit = F.when(F.col("_k") > 0, F.struct(F.col("_at").alias("at"), F.col("_k").alias("k")))
    found = rows.groupBy(key, "text_hash", "n_words").agg(
        F.sum((F.col("_k") == 0).cast("int")).alias("_copies"),
        F.array_sort(F.collect_set(hit)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_copy")


def covered(hits: str | Column) -> Column:
    """Positions of the words inside any hit."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["k"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated: what `find` gives, summed up."""
    return find(docs, benchmark, key, text, item).select(
        key, "n_words",
        F.size(covered("hits")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def remove(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", spans: bool = False
) -> DataFrame:
    """`docs` without contaminated rows, or (`spans`) with the words of the hits and what follows each cut out.

    All columns stay; clean rows are unchanged. Only contaminated rows are matched with their
    hits; rows with equal key and text are alike.
    """
    same_key, same_text, met, gone, marks, pieces = spare(docs, "_key", "_hash", "_hits", "_gone", "_marks", "_pieces")
    hits = find(docs, benchmark, key, text, item).filter(F.size("hits") > 0).select(
        F.col(key).alias(same_key), F.col("text_hash").alias(same_text), F.col("hits").alias(met)
    ).dropDuplicates([same_key, same_text])
    match = F.col(key).eqNullSafe(F.col(same_key)) & (F.xxhash64(text) == F.col(same_text))
    if not spans:
        return docs.join(hits, match, "left_anti")
    # The text as a lead and one piece per word (the word and what follows it), so cutting words keeps the rest.
    # Here A-Z count as letters, as the text is not in lower case.
    gap = BREAKS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    word = gap.replace("[", "[^", 1)
    lead = F.regexp_extract(text, f"^{gap}*", 0)
    cut = F.regexp_extract_all(text, F.lit(f"({word}+{gap}*)"), F.lit(1))
    hit = F.col(met).isNotNull()
    joined = (
        docs.join(hits, match, "left")
        .withColumn(gone, covered(met)).withColumn(pieces, F.when(hit, cut))
        .withColumn(marks, F.map_from_arrays(F.col(gone), F.transform(gone, lambda _: F.lit(True))))
    )
    kept = F.filter(pieces, lambda _, i: ~F.map_contains_key(marks, i))
    new = F.when(hit, F.concat(lead, F.concat_ws("", kept))).otherwise(F.col(text))
    return joined.withColumn(text, new).select(*all_of(docs))
