"""How far the sources of a language differ in their words.

Words are counted inside tasks and summed by Spark per language, source and word. The counts of
the words a language keeps, dealt by word to blocks of bounded size, are its word-major index: in a
block every source's row runs through the postings of its words and adds what each peer's count
changes into one dense accumulator over all peers. Pairs of postings are never rows; a block emits
one sum per pair of sources. A source without a word still has a share there, the one of count
zero: sums start from shares of zero and the accumulators carry the corrections.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import all_of, byte_table, runs, settled, text_bytes

SCALE = 1_000_000_000
SMOOTH = 5
LEAST_DOCUMENTS = 30
TOP = 50
BLOCK = 1 << 18  # postings a block holds, as the hash of their words deals them
TILE_SUMS = 1 << 20  # sums that a block emits at once; with more sources their rows go to several tiles
PIECE = 1 << 20  # bytes of a text that are split into words at once
RUN = 1 << 22  # bytes of texts that are counted together
ENTRIES = 1 << 22  # counts a task sums up before it passes half as many on
WORDS = 1 << 20  # distinct words it holds
BREAKS = byte_table(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
# Words in lower case, everything between them a blank.
FOLDED = bytes(0x20 if BREAKS[b] else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a folded text, some at a time; cuts are made at blanks."""
    start = 0
    while len(text) - start > PIECE:
        stop = text.find(b" ", start + PIECE)
        if stop < 0:
            break
        yield text[start:stop].split()
        start = stop
    yield text[start:].split()


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each value over the rows of a key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


class _Counts:
    """Counts of words per group: words and groups by number, sums as sorted arrays."""

    def __init__(self):
        self.words: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.groups: defaultdict[tuple[str, str], int] = defaultdict(count().__next__)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, texts: list[tuple[int, np.ndarray]]) -> None:
        """Count texts, given as (group, numbers of the words)."""
        sizes = [len(codes) for _, codes in texts]
        rows = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
        # Once per text and word first: the number of such rows is the number of texts with the word.
        found = np.sort(rows << 32 | np.concatenate([codes for _, codes in texts]))
        first = np.flatnonzero(np.diff(found, prepend=found[:1] - 1))
        times = np.diff(first, append=len(found))
        group = np.array([g for g, _ in texts], np.int64)
        keys = group[found[first] >> 32] << 32 | found[first] & 0xFFFFFFFF
        self.parts.append(_summed(keys, times, np.ones(len(times), np.int64)))
        self.held += len(self.parts[-1][0])
        if self.held > ENTRIES:
            self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.held = len(self.parts[0][0])

    def full(self) -> bool:
        return self.held > ENTRIES // 2 or len(self.words) > WORDS

    def told(self) -> pa.RecordBatch:
        keys, times, documents = _summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        group, word = pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF)
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()).take(group) for k in (0, 1))
        terms = pa.array(list(self.words), pa.binary()).cast(pa.string()).take(word)
        columns = [langs, sources, terms, pa.array(times), pa.array(documents)]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "documents"])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, documents): sums over some of the rows."""
    counts = _Counts()
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        data, bounds = text_bytes(batch.column(2))
        for start, stop in runs(bounds, RUN):
            texts = []
            for row in range(start, stop):
                number = counts.words.__getitem__
                text = data[bounds[row] : bounds[row + 1]].tobytes().translate(FOLDED)
                codes = [np.fromiter(map(number, words), np.int64, len(words)) for words in _pieces(text)]
                texts.append((counts.groups[langs[row], sources[row]], np.concatenate(codes)))
            counts.add(texts)
            if counts.full():
                yield counts.told()
                counts = _Counts()
    if counts.parts:
        yield counts.told()


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 5) / (total + 5 * terms)) in longs; the division is done in two steps, so nothing overflows."""
    under = f"greatest({total} + {SMOOTH} * {terms}, 1L)"
    over = f"(100000L * ({n} + {SMOOTH}))"
    return F.expr(f"({over} div {under}) * {SCALE // 100000}L + ({SCALE // 100000}L * ({over} % {under})) div {under} + 1L")


def _scatter(postings: pd.DataFrame, peers: pd.DataFrame, first: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(source, what to add to its row, what to add to its column) for the sources of a tile.

    `peers` holds g (0 to its length), zero (the share of a word that never occurs there), mine
    (whether the tile has the row) and terms (how many words the language keeps); `postings` the
    columns term, g, p.
    """
    peers = peers.rename(columns=lambda c: c.removesuffix("_")).sort_values("g")
    zero, terms = peers["zero"].to_numpy(np.int64), int(peers["terms"].iloc[0])
    row_of, _ = pd.factorize(postings["term"])
    by_term = np.argsort(row_of, kind="stable")
    row_of, g, p = row_of[by_term], *(postings[c].to_numpy(np.int64)[by_term] for c in ("g", "p"))
    bounds = np.searchsorted(row_of, np.arange(row_of.max(initial=-1) + 2))
    by_group = np.argsort(g, kind="stable")
    groups = np.searchsorted(g[by_group], np.arange(len(zero) + 1))
    for own in np.flatnonzero(peers["mine"].to_numpy(bool)):
        if not first and groups[own] == groups[own + 1]:
            continue
        acc = terms * np.abs(zero[own] - zero) if first else np.zeros(len(zero), np.int64)
        spots = by_group[groups[own] : groups[own + 1]]
        # Words of this source, against peers without them: sums of |p - zero| from sorted shares.
        shares = np.sort(p[spots])
        upto = np.concatenate([[0], np.cumsum(shares)])
        less = np.searchsorted(shares, zero)
        alone = upto[-1] - 2 * upto[less] - (len(shares) - 2 * less) * zero - len(shares) * np.abs(zero[own] - zero)
        # Words that both have: through the word's postings into the accumulator.
        starts, stops = bounds[row_of[spots]], bounds[row_of[spots] + 1]
        sizes = stops - starts
        ends = np.cumsum(sizes)
        for a, b in _runs(ends, BLOCK):
            here = sizes[a:b]
            at = np.arange(here.sum()) + np.repeat(starts[a:b] - (ends[a:b] - here - (ends[a - 1] if a else 0)), here)
            mine, peer, theirs = np.repeat(p[spots[a:b]], here), g[at], p[at]
            change = np.abs(mine - theirs) - np.abs(mine - zero[peer]) - np.abs(zero[own] - theirs) + np.abs(zero[own] - zero[peer])
            np.add.at(acc, peer, change)
        yield int(own), acc + alone, alone


def _runs(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes, with running totals `ends`, add up to about `limit`."""
    start = 0
    while start < len(ends):
        stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")), start + 1)
        yield start, stop
        start = stop


def _pair_sums(key: tuple, postings: pd.DataFrame, peers: pd.DataFrame) -> pd.DataFrame:
    """(lang, g, h, value): what a block of words adds to the pairs whose row is of this tile."""
    first, everyone = key[1] == 0, np.arange(len(peers))
    g, h, value = [], [], []
    for own, row, column in _scatter(postings, peers, first):
        there = everyone[((row != 0) | first) & (everyone != own)]
        back = everyone[(column != 0) & (everyone != own)]
        g += [np.full(len(there), own), back]
        h += [there, np.full(len(back), own)]
        value += [row[there], column[back]]
    out = {"g": g, "h": h, "value": value}
    frame = pd.DataFrame({name: np.concatenate(v) if v else np.zeros(0, np.int64) for name, v in out.items()})
    frame.insert(0, "lang", key[0])
    return frame


def divergence(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, top: int = TOP,
    block: int = BLOCK, tile: int = TILE_SUMS,
) -> DataFrame:
    """lang, source, part, item, value, rank: for every source of a language how far it is from the others, and its own words.

    A language keeps the words in at least `least` of its rows. Every source that occurs, even
    without words, and the language itself give each kept word a smoothed share. Part `pair`: for
    each other source of the language the sum of all differences of shares (0 where no word is
    kept), all ranks. Part `term`: the `top` words of the source whose share is over the language's.

    Null texts, languages and sources are read as empty; repeated rows count as often as they
    occur; a language with one source has no pairs; an empty table gives no rows; other columns are
    not read. Texts are read whole, in pieces. Counts are summed before they are dealt, so a source
    or word with most of the rows is as good as any other; a word's postings are one entry per
    source. Ties are broken by the bytes of the item.
    """
    column = dict(zip(docs.columns, all_of(docs), strict=True))
    named = [F.coalesce(column[c], F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]
    counts = (
        docs.select(*named, column[text].alias("text"))
        .mapInArrow(count_words, "lang string, source string, term string, n long, documents long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    )
    index = settled(
        counts.groupBy("lang", "term")
        .agg(F.sum("n").alias("of_lang"), F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("postings"))
        .filter(F.col("documents") >= least).drop("documents"),
        "divergence-index",
    )
    single = index.select("lang", "term", "of_lang", F.inline("postings"))
    langs = index.groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("of_lang").alias("lang_total"), F.sum(F.size("postings")).alias("entries")
    )
    totals = single.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = {"terms": 0, "lang_total": 0, "entries": 0, "total": 0}
    groups = settled(
        docs.select(*named).distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(none)
        .withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
        .withColumn("peers", F.count("*").over(Window.partitionBy("lang")))
        .withColumn("zero", share("0L", "total", "terms"))
        .withColumn("blocks", F.greatest(F.ceil(F.col("entries") / block), F.lit(1)))
        .withColumn("tiles", F.ceil(F.col("peers") * F.col("peers") / tile)),
        "divergence-groups",
    )
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    shares = single.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms"))
    dealt = shares.select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), upto("tiles").alias("tile"),
        "term", "g", "p",
    )
    # Columns under names of their own: the two sides of a cogroup must not share them.
    roster = groups.select(*(F.col(c).alias(f"{c}_") for c in groups.columns))
    every = roster.select("*", upto("blocks_").alias("block_")).select("*", upto("tiles_").alias("tile_")).select(
        "lang_", "block_", "tile_", "g_", "zero_", "terms_", (F.col("g_") % F.col("tiles_") == F.col("tile_")).alias("mine_")
    )
    keys = ["lang", "block", "tile"]
    sums = (
        dealt.groupBy(*keys).cogroup(every.groupBy(*(f"{k}_" for k in keys))).applyInPandas(_pair_sums, "lang string, g long, h long, value long")
        .groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    )
    mine = groups.select("lang", "g", "source")
    theirs = groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    pairs = sums.join(mine, ["lang", "g"]).join(theirs, ["lang", "h"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    words = (
        shares.withColumn("value", F.col("p") - share("of_lang", "lang_total", "terms")).filter("value > 0")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    )
    both = pairs.withColumn("rank", ranked).union(words.withColumn("rank", ranked).filter(F.col("rank") <= top))
    return both.withColumnsRenamed({"lang": lang, "source": source})
