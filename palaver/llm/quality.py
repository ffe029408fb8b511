"""Quality rules: base counts, and a hashed n-gram likelihood ratio of trusted to raw text.

Every text is described by the hashes of its words and word pairs. Two multinomials over the
hash buckets, one from trusted texts and one from the whole corpus, give each text the mean
log-likelihood ratio of its features; a text is kept if that mean reaches a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import Hasher, Words, byte_table, mix, sums, text_runs

BUCKET_BITS = 16
SMOOTHING = 10.0  # added to the count of every bucket: rare features say little
THRESHOLD = -0.1  # nats per feature
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"  # fixed value

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"


def _features(words: Words, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and the buckets of words and word pairs; a pair that crosses texts has bucket -1."""
    hashes = hasher.ranges(words.starts, words.ends)
    shift = np.uint64(64 - BUCKET_BITS)
    single = (mix(hashes + np.uint64(1)) >> shift).astype(np.int64)
    pair = np.full(len(hashes), -1, np.int64)
    if len(hashes) > 1:
        both = mix(hashes[:-1] * np.uint64(3) + hashes[1:] * np.uint64(5))
        pair[:-1] = np.where(words.text[:-1] == words.text[1:], both >> shift, -1)
    return hashes, np.stack([single, pair])


def _grouped(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(keys ^ mix(text.astype(np.uint64) + np.uint64(11)))


def _repeated_words(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Per text, the words inside 3-word windows that occur twice or more in it."""
    hit = np.zeros(len(hashes) + 2, bool)
    if len(hashes) > 2:
        whole = words.text[:-2] == words.text[2:]
        window = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7)
        at = np.flatnonzero(whole)
        _, group, count = np.unique(
            _grouped(mix(window[at]), words.text[at]), return_inverse=True, return_counts=True
        )
        at = at[count[group] > 1]
        for k in range(3):
            hit[at + k] = True
    return sums(hit[: len(hashes)], words.bounds)


def _repeated_lines(data: np.ndarray, bounds: np.ndarray, words: Words, hasher: Hasher) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of the text."""
    newline = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([bounds[:-1][bounds[:-1] < bounds[1:]], newline + 1]))
    starts = starts[starts < len(data)]
    breaks = np.append(newline, len(data))
    ends = np.minimum(breaks[np.searchsorted(breaks, starts)], bounds[np.searchsorted(bounds, starts, side="right")])
    worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[worded], ends[worded]
    text = np.searchsorted(bounds, starts, side="right") - 1
    keys, first = np.unique(_grouped(hasher.ranges(starts, ends), text), return_index=True)
    again = np.ones(len(starts), np.int64)
    again[first] = 0
    return np.bincount(text, weights=again, minlength=len(bounds) - 1).astype(np.int64)


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each bucket in all texts and in the trusted ones, one row per bucket and task."""
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    hasher = Hasher()
    for batch in batches:
        trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for start, stop, data, bounds in text_runs(batch.column(0)):
            words = Words(data, bounds)
            hasher.load(data)
            _, buckets = _features(words, hasher)
            marked = trusted[start:stop][words.text]
            for some, row in ((buckets, 0), (buckets[:, marked], 1)):
                counts[row] += np.bincount(some[some >= 0], minlength=1 << BUCKET_BITS)
    used = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array(counts[0][used]), pa.array(counts[1][used])],
        ["bucket", "raw", "trusted"],
    )


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(_trusted): the keys of the trusted documents, each once."""
    return labels.filter((F.col("quality") == 1) & F.col(key).isNotNull()).select(F.col(key).alias("_trusted")).distinct()


def fit_ratio(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """log(p trusted / p raw) of every bucket: all texts count for the raw side, all trusted ones for the other.

    The driver gets one row per bucket, however large the corpus is. Without trusted texts all
    ratios are 0. Texts meet the trusted keys in a sort-merge join at every size, as those grow with
    the corpus; a key with very many texts is on the side that Spark may split.
    """
    marked = docs.select(key, text).join(trusted_ids(labels, key).hint("merge"), F.col(key) == F.col("_trusted"), "left")
    counts = (
        marked.select(F.col(text), F.col("_trusted").isNotNull().alias("trusted"))
        .mapInArrow(count_features, "bucket int, raw long, trusted long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
        .toPandas()
    )
    table = np.zeros((2, 1 << BUCKET_BITS))
    table[:, counts["bucket"].to_numpy(int)] = counts["raw"], counts["trusted"]
    if not table[1].sum():
        return np.zeros(1 << BUCKET_BITS)
    table[0] *= table[1].sum() / table[0].sum()  # both sides then weigh the same against the smoothing
    table += SMOOTHING
    return np.log(table[1] / table[0])


def measure(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    hasher, symbols = Hasher(), byte_table(SYMBOLS)
    weight = np.append(ratio, 0.0)  # the last for bucket -1
    for batch in batches:
        out = [[] for _ in range(6)]
        for _, _, data, bounds in text_runs(batch.column(1)):
            words = Words(data, bounds)
            hasher.load(data)
            hashes, buckets = _features(words, hasher)
            features = sums((buckets >= 0).sum(axis=0), words.bounds)
            score = np.add.reduceat(
                np.append(weight[buckets].sum(axis=0), 0.0), np.minimum(words.bounds[:-1], len(hashes))
            ) if len(words.counts) else np.zeros(0)
            for i, column in enumerate((
                words.counts,
                sums(words.inside & ((data & 0xC0) != 0x80), bounds),
                sums(symbols[data], bounds),
                _repeated_lines(data, bounds, words, hasher),
                _repeated_words(words, hashes),
                np.where(features > 0, score / np.maximum(features, 1), 0.0),
            )):
                out[i].append(column)
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        kinds = [pa.int64()] * 5 + [pa.float64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds, strict=True))],
            [batch.schema.names[0], *(f.split()[0] for f in MEASURES.split(", "))],
        )


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of `docs`: key, base counts, `llr`, `base_failed`, `kept`.

    `labels` has the key and `quality`; texts with quality 1 are trusted. A null or blank text has no words and fails; repeated rows get
    equal rows; null keys are kept as they are; an empty table gives no rows. Other columns are
    not read. The mean ratio must be `threshold` or more.
    """
    ratio = fit_ratio(docs, labels, key, text)
    kind = docs.schema[key].dataType.simpleString()
    measured = docs.select(key, text).mapInArrow(lambda batches: measure(batches, ratio), f"`{key}` {kind}, {MEASURES}")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("llr") >= threshold)
    )
