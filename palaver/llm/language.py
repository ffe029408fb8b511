"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. The vectors of three
neighbouring letters are permuted by position and multiplied (bound) into the vector of their
3-gram; the vectors of all 3-grams of a text are added (bundled) into its profile. A language's
prototype bundles the 3-grams of all its learning texts. A text gets the language whose
prototype has the largest cosine with its profile.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import text_bytes, worker_state

DIMENSIONS = 1024
SEED = 20
FOLDS, HELD_OUT = 5, 0
MIN_SCORE = 0.08  # 2.5 times the noise 1 / sqrt(DIMENSIONS): unrelated letters reach about 0.05
LEAST_GRAMS = 100  # so many even 3-grams a text must have for its cosine to speak against it
UNKNOWN = "und"
RUN_BYTES, RUN_ROWS, BLOCK = 1 << 18, 128, 4096
LEARN_BYTES, LEARN_ROWS = 1 << 21, 1 << 14


def _letters() -> np.ndarray:
    """Lower-case letter of every code point; 0 for what is not a letter."""
    state = worker_state("letters")
    if "table" not in state:
        table = np.zeros(0x110000, np.int32)
        for i in itertools.chain(range(0xD800), range(0xE000, 0x110000)):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0])
        state["table"] = table
    return state["table"]


class LetterVectors:
    """Random vectors of letters; the word boundary (0) has one too."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.known = dimensions, {}

    def of(self, letters: np.ndarray) -> np.ndarray:
        for c in letters:
            if int(c) not in self.known:
                bits = np.random.default_rng((SEED, int(c))).integers(0, 2, self.dimensions)
                self.known[int(c)] = (2 * bits - 1).astype(np.float32)
        return np.stack([self.known[int(c)] for c in letters])


class Grams:
    """The 3-grams of a run of texts: `letters` indexed by `keys`, with the text each one is in."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        text = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        at = heads[bounds]
        symbols = np.insert(_letters()[text], at, 0)  # a boundary before and after each text
        owner = np.insert(np.repeat(np.arange(len(at) - 1), np.diff(at)), at, np.append(np.arange(len(at) - 1), len(at) - 2))
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0)
        symbols, owner = symbols[keep], owner[keep]
        flags = np.zeros(int(symbols.max(initial=0)) + 1, bool)
        flags[symbols] = True
        self.letters = np.flatnonzero(flags)
        index = np.zeros(len(flags), np.int64)
        index[self.letters] = np.arange(len(self.letters))
        coded, size = index[symbols], len(self.letters)
        middle = np.flatnonzero(symbols[1:-1] > 0) + 1 if len(symbols) > 2 else np.zeros(0, np.int64)
        grams = (coded[middle - 1] * size + coded[middle]) * size + coded[middle + 1]
        self.text = owner[middle]
        if size**3 <= 1 << 22:
            flags = np.zeros(size**3, bool)
            flags[grams] = True
            self.keys = np.flatnonzero(flags)
            rank = np.cumsum(flags) - 1
            self.column = rank[grams]
        else:
            self.keys, self.column = np.unique(grams, return_inverse=True)

    def bundle(self, owner: np.ndarray, owners: int, vectors: LetterVectors) -> np.ndarray:
        """Sum of the 3-gram vectors of each owner (a number for each 3-gram)."""
        size, out = len(self.letters), np.zeros((owners, vectors.dimensions), np.float32)
        if not len(self.keys):
            return out
        base = vectors.of(self.letters)
        once, twice = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
        counts = np.bincount(owner * len(self.keys) + self.column, minlength=owners * len(self.keys))
        counts = counts.reshape(owners, -1).astype(np.float32)
        for k in range(0, len(self.keys), BLOCK):
            some = self.keys[k : k + BLOCK]
            bound = twice[some // size**2] * once[some // size % size]
            bound *= base[some % size]
            out += counts[:, k : k + BLOCK] @ bound
        return out


def _runs(column: pa.Array, limit: int, rows: int):
    data, bounds = text_bytes(column)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), start + rows, len(column))
        yield start, stop, data[bounds[start] : bounds[stop]], bounds[start : stop + 1] - bounds[start]
        start = stop


def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundles of each language over a task's texts, one row per language."""
    vectors, bundles = LetterVectors(), {}
    for batch in batches:
        names = batch.column(1).dictionary_encode()
        langs, which = names.dictionary.to_pylist(), names.indices.to_numpy()
        for start, stop, data, bounds in _runs(batch.column(0), LEARN_BYTES, LEARN_ROWS):
            grams = Grams(data, bounds)
            sums = grams.bundle(which[start:stop][grams.text].astype(np.int64), len(langs), vectors)
            for lang, total in zip(langs, sums, strict=True):
                bundles[lang] = bundles.get(lang, 0) + total.astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(bundles), pa.string()), pa.array([b.tolist() for b in bundles.values()], pa.list_(pa.int64()))],
        ["lang", "bundle"],
    )


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes of length 1, from all rows with text and language.

    The driver gets one vector per language.
    """
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = (
        known.select(F.col(text), F.col(lang)).mapInArrow(learn, "lang string, bundle array<long>")
        .select("lang", F.posexplode("bundle").alias("at", "value"))
        .groupBy("lang", "at").agg(F.sum("value").alias("value"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("bundle"))
        .select("lang", F.col("bundle.value").alias("bundle")).orderBy("lang").collect()
    )
    table = np.array([r.bundle for r in rows], np.float64).reshape(len(rows), -1 if rows else DIMENSIONS)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    kept = length[:, 0] > 0
    return [r.lang for r, k in zip(rows, kept, strict=True) if k], (table[kept] / length[kept]).astype(np.float32)


def _best(column: pa.Array, langs: list[str], table: np.ndarray, vectors: LetterVectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the best language of each text (their count where there is none), its cosine, and how many 3-grams tell it.

    The last is the number of equally frequent 3-grams that give a profile of this length: one
    repeated 3-gram tells no more than a single one.
    """
    best, scores, told = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
    for _, _, data, bounds in _runs(column, RUN_BYTES, RUN_ROWS):
        grams = Grams(data, bounds)
        profile = grams.bundle(grams.text, len(bounds) - 1, vectors)
        length = np.linalg.norm(profile, axis=1)
        cosines = np.zeros((len(length), len(langs) + 1), np.float32)
        cosines[:, :-1] = profile @ table.T / np.maximum(length, 1e-9)[:, None]
        cosines[:, -1] = np.where((length > 0) & bool(langs), -2, 2)
        at = cosines.argmax(axis=1)
        best.append(at)
        scores.append(np.where(at == len(langs), 0, np.clip(cosines[np.arange(len(at)), at], 0, 1)))
        total = np.bincount(grams.text, minlength=len(length)).astype(np.float64)
        told.append((total / np.maximum(length, 1e-9)) ** 2 * vectors.dimensions)
    return np.concatenate(best), np.concatenate(scores).astype(np.float64), np.concatenate(told)


def predict(batches: Iterator[pa.RecordBatch], langs: list[str], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    vectors, names = LetterVectors(), np.array([*langs, UNKNOWN], object)
    for batch in batches:
        best, scores, _ = _best(batch.column(1), langs, table, vectors)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names[best], pa.string()), pa.array(scores)],
            [batch.schema.names[0], "lang_pred", "score"],
        )


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (cosine, 0 to 1) of every row, whole texts.

    A null text, one without letters, or no learned language: `und` with score 0. Repeated rows
    get equal rows, an empty table none. Of equal cosines the first language by name wins. Runs
    of texts are profiled together; a very long text is a run of its own.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        lambda batches: predict(batches, langs, table), f"`{key}` {kind}, lang_pred string, score double"
    )


def _keep(batches: Iterator[pa.RecordBatch], langs: list[str], table: np.ndarray, at: int, least: float) -> Iterator[pa.RecordBatch]:
    vectors = LetterVectors()
    for batch in batches:
        best, scores, told = _best(batch.column(at), langs, table, vectors)
        yield batch.filter(pa.array((best < len(langs)) & ((scores >= least) | (told < LEAST_GRAMS))))


def keep_known(docs: DataFrame, langs: list[str], table: np.ndarray, text: str = "text", least: float = MIN_SCORE) -> DataFrame:
    """The rows of `docs`, all columns, but those without letters and those that are of no learned language.

    A score under `least` tells that only of a text with enough 3-grams (`LEAST_GRAMS`): a short
    one scores low in its own language. The prediction is that of `identify`; rows pass through
    it, so keys need not be unique. An empty table gives no rows.
    """
    at, plain = docs.columns.index(text), docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may hold dots
    kept = plain.mapInArrow(lambda batches: _keep(batches, langs, table, at, least), plain.schema)
    return kept.toDF(*docs.columns)
