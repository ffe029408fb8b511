"""Toxicity with noisy-channel deobfuscation.

A character language model is counted over the whole corpus. Spans that look written to hide a
word (digits or signs among letters, letters set apart, letters repeated) become lattices of what
each character may stand for; the best path under the channel's costs and the language model is
the restored word. Texts with their restored words are scored by a linear model over words and
word beginnings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import mix, settled, text_runs
from palaver.llm.language import _letters

FOLDS, HELD_OUT = 4, 2
CUT = 0.3
LABEL_BOUND = 20_000  # labelled documents that the linear model is fitted on
FEATURES = 4096  # features that may carry weight, by their likelihood ratio
LEAST_RATIO = 8.0  # log-likelihood ratio a feature must reach
PREFIXES = (4, 5)
THREE_BITS, TWO_BITS = 18, 16
ALPHABET = 64.0  # letters that share the smoothing mass
RIDGE, STEPS = 0.02, 400

# What a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "+": "t", "€": "e", "£": "l",
}
SUBSTITUTE, REPEAT, NOISE, APART = 1.0, 0.7, 8.0, 0.2  # costs in nats
BREAK = 1.0  # of a word break in a gap between letters set apart; APART where the gap is wider than one beside it
NEAR = 6.0  # words of a span set apart that lie on a path this much dearer than the best one are restored as well
LONGEST = 40  # letters of a word set apart


WINDOW = 1024  # letters of a span set apart whose words are held at once
REMEMBERED = 256  # characters of the spans whose words a decoder remembers

START: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # two letters before: cost, path


class Letters:
    """Letters of a run of texts as code points, in lower case, 0 elsewhere; tokens of letters and signs."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.text = data.tobytes().decode()
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        heads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        self.bounds = heads[bounds]
        self.letters = _letters()[points]
        signs = np.zeros(0x20AD, bool)
        signs[[ord(c) for c in STANDS_FOR]] = True
        self.signs = signs[np.minimum(points, 0x20AD - 1)]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of `inside` that do not cross texts."""
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        first = self.bounds[:-1][self.bounds[:-1] < self.bounds[1:]]
        before[first] = False
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        after[first[1:] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def suspects(self) -> list[tuple[int, int, bool]]:
        """(start, end, set apart) of spans that may hide a word."""
        letter = self.letters > 0
        starts, ends = self.spans(letter | self.signs)
        if not len(starts):
            return []

        def within(flags):
            total = np.concatenate([[0], np.cumsum(flags)])
            return total[ends] - total[starts]

        twice = np.zeros(len(letter), bool)
        twice[1:] = letter[1:] & (self.letters[1:] == self.letters[:-1])
        n_letters, n_signs = within(letter), within(self.signs)
        # any doubled letter may be a repetition: the letter model decides, once per distinct word
        odd = (n_letters > 0) & ((n_signs > 0) | (within(twice) > 0))
        out = [(a, b, False) for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)]
        # runs of four or more single characters with at most two others between them
        text = np.searchsorted(self.bounds, starts, side="right")
        single = ends - starts == 1
        linked = single[1:] & single[:-1] & (starts[1:] - ends[:-1] <= 2) & (text[1:] == text[:-1])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], linked.astype(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= 3 and n_letters[a : b + 1].sum() * 2 >= b - a + 1:
                out.append((int(starts[a]), int(ends[b]), True))
        return out


def _three(a, b, c) -> np.ndarray:
    a, b, c = (np.asarray(x).astype(np.uint64) for x in (a, b, c))
    return (mix((a << np.uint64(42)) + (b << np.uint64(21)) + c + np.uint64(1)) >> np.uint64(64 - THREE_BITS)).astype(np.int64)


def _two(a, b) -> np.ndarray:
    a, b = (np.asarray(x).astype(np.uint64) for x in (a, b))
    return (mix((a << np.uint64(21)) + b + np.uint64(7)) >> np.uint64(64 - TWO_BITS)).astype(np.int64)


def count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of hashed letter triples and of the pairs before them, words apart by 0; one row per bucket and task."""
    counts = np.zeros((1 << THREE_BITS) + (1 << TWO_BITS), np.int64)
    for batch in batches:
        for _, _, data, bounds in text_runs(batch.column(0)):
            run = Letters(data, bounds)
            x = np.insert(run.letters, run.bounds, 0)
            x = np.concatenate([[0, 0], x[(x > 0) | np.append(True, x[:-1] > 0)]])
            if len(x) < 3:
                continue
            # the pair before a word's first letter is two breaks, whatever came before it
            first = np.where(x[1:-1] == 0, 0, x[:-2])
            counts[: 1 << THREE_BITS] += np.bincount(_three(first, x[1:-1], x[2:]), minlength=1 << THREE_BITS)
            counts[1 << THREE_BITS :] += np.bincount(_two(first, x[1:-1]), minlength=1 << TWO_BITS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "n"])


@dataclass
class LetterModel:
    """p(letter | two letters before) from hashed counts, smoothed."""

    three: np.ndarray
    two: np.ndarray

    def cost(self, a: int, b: int, c: int) -> float:
        up, down = self.three[_three([a], [b], [c])[0]], self.two[_two([a], [b])[0]]
        return -float(np.log((up + 1 / ALPHABET) / (down + 1)))


def fit_letters(docs: DataFrame, text: str = "text") -> LetterModel:
    """Counted over all rows; the driver gets one row per bucket, however large the corpus is."""
    rows = docs.select(text).mapInArrow(count_letters, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((1 << THREE_BITS) + (1 << TWO_BITS))
    counts[rows["bucket"].to_numpy(int)] = rows["n"]
    return LetterModel(counts[: 1 << THREE_BITS], counts[1 << THREE_BITS :])


class Decoder:
    """Viterbi search through the lattice of a span; short spans and letter costs are remembered."""

    def __init__(self, model: LetterModel):
        self.model = model
        self.costs: dict[tuple[int, int, int], float] = {}
        self.remembered = lru_cache(1 << 16)(self._words)

    def words(self, text: str, apart: bool) -> tuple[str, ...]:
        """What a span is restored to, where that is not the span itself."""
        return self.remembered(text, apart) if len(text) <= REMEMBERED else self._words(text, apart)

    def _cost(self, three: tuple[int, int, int]) -> float:
        if len(self.costs) > 1 << 16:
            self.costs.clear()
        cost = self.costs[three] = self.model.cost(*three)
        return cost

    def _arcs(self, span: str, apart: bool) -> Iterator[list[tuple[int, float]]]:
        """For each character, the letters it may give (0: none) and their costs."""
        last = ""
        for c in span:
            if c in STANDS_FOR:
                arcs = [(ord(x), SUBSTITUTE) for x in STANDS_FOR[c]] + [(0, REPEAT if c == last else NOISE)]
            elif c.isalpha():
                arcs = [(ord(c), 0.0)] + ([(0, REPEAT)] if c == last else [])
            else:
                arcs = [(0, APART if apart else NOISE)]
            last = c
            yield arcs

    def _step(self, best: dict, arcs: list[tuple[int, float]]) -> dict:
        after: dict = {}
        known = self.costs.get
        for (a, b), (cost, path) in best.items():
            for letter, extra in arcs:
                if letter:
                    more = known((a, b, letter))
                    total = cost + extra + (self._cost((a, b, letter)) if more is None else more)
                    state, way = (b, letter), (letter, path)
                else:
                    total, state, way = cost + extra, (a, b), path
                if state not in after or total < after[state][0]:
                    after[state] = total, way
        return after

    def _end(self, best: dict) -> tuple[float, tuple | None]:
        """Cost and path of the best way when the word ends."""
        known = self.costs.get
        least, way = np.inf, None
        for (a, b), (cost, path) in best.items():
            more = known((a, b, 0))
            total = cost + (self._cost((a, b, 0)) if more is None else more)
            if total < least:
                least, way = total, path
        return least, way

    def _from(self, i: int, nodes: list[int], breaks: dict[int, float], steps: list) -> Iterator[tuple[int, float, tuple | None]]:
        """The words from node `i` of a span set apart: (node where it ends, cost, path); each gap is passed or ends it."""
        best = START
        for j in range(i + 1, min(i + LONGEST, len(nodes) - 1) + 1):
            for at in range(nodes[j - 1], nodes[j]):
                if at in breaks:
                    cost, path = self._end(best)
                    yield j, cost + breaks[at], path
                best = self._step(best, steps[at])
        if nodes[j] == nodes[-1]:
            yield j, *self._end(best)

    def _decode(self, span: str, apart: bool) -> tuple[str, ...]:
        """The restored word; of a span set apart every word on a path at most NEAR dearer than the best.

        What a long span holds in memory is a cost for each letter, and the words of WINDOW letters:
        costs from the start are worked out in one pass, then the span is gone through again from
        its end, window by window, with the costs to the end. Cut or not, the words are the same.
        """
        steps = list(self._arcs(span, apart)) if len(span) <= 4 * WINDOW else _Steps(self, span, apart)
        if not apart:
            best = START
            for arcs in steps:
                best = self._step(best, arcs)
            return (_spelled(self._end(best)[1]),)
        breaks = _breaks(span)
        nodes = [0, *(at + 1 for at in breaks), len(span)]
        size = len(nodes) - 1
        before, behind = np.full(size + 1, np.inf), np.full(size + 1, np.inf)
        before[0] = behind[-1] = 0.0
        held = None
        if size <= WINDOW:
            held = [(i, *word) for i in range(size) for word in self._from(i, nodes, breaks, steps)]
        for i, j, cost in ((i, j, cost) for i, j, cost, _ in held) if held is not None else (
            (i, j, cost) for i in range(size) for j, cost, _ in self._from(i, nodes, breaks, steps)
        ):
            before[j] = min(before[j], before[i] + cost)
        found: list[list[str]] = []
        for stop in range(size, 0, -WINDOW):
            start = max(stop - WINDOW, 0)
            some = held if held is not None else [(i, *word) for i in range(start, stop) for word in self._from(i, nodes, breaks, steps)]
            for i, j, cost, _ in reversed(some):
                behind[i] = min(behind[i], behind[j] + cost)
            near = (_spelled(path) for i, j, cost, path in some if before[i] + cost + behind[j] <= before[-1] + NEAR)
            found.append(list(dict.fromkeys(near)))
        return tuple(dict.fromkeys(word for words in reversed(found) for word in words))

    def _words(self, text: str, apart: bool) -> tuple[str, ...]:
        span = _plain(text)
        if not any(c.isalpha() for c in span):
            return ()
        return tuple(word for word in self._decode(span, apart) if word and word != span)


class _Steps:
    """The arcs of a long span's characters, worked out in runs when they are asked for."""

    def __init__(self, decoder: Decoder, span: str, apart: bool):
        self.decoder, self.span, self.apart = decoder, span, apart
        self.runs: dict[int, list] = {}

    def __getitem__(self, at: int) -> list[tuple[int, float]]:
        run, place = divmod(at, WINDOW)
        if run not in self.runs:
            if len(self.runs) > 8:
                self.runs.clear()
            start = run * WINDOW
            some = list(self.decoder._arcs(self.span[max(start - 1, 0) : start + WINDOW], self.apart))
            self.runs[run] = some[start > 0 :]
        return self.runs[run][place]

    def __iter__(self) -> Iterator[list[tuple[int, float]]]:
        return (self[at] for at in range(len(self.span)))


def _spelled(path: tuple | None) -> str:
    out = []
    while path is not None:
        out.append(chr(path[0]))
        path = path[1]
    return "".join(reversed(out))


def _breaks(span: str) -> dict[int, float]:
    """The last place of each gap of a span set apart, and what a word break costs there."""
    gaps, start = [], None
    for at, c in enumerate(span + "a"):
        if c.isalpha() or c in STANDS_FOR:
            if start is not None:
                gaps.append((at - 1, at - start))
            start = None
        elif start is None:
            start = at
    out = {}
    for k, (at, width) in enumerate(gaps):
        beside = [w for _, w in gaps[max(k - 1, 0) : k + 2]]
        out[at] = APART if width > min(beside) else BREAK
    return out


def _plain(span: str) -> str:
    """A span without the marks that end words; three or more equal signs at its end are ornament."""
    span = span.lower().strip("!+")
    while span and span[-1] in STANDS_FOR and span.endswith(span[-1] * 3):
        span = span.rstrip(span[-1])
    return span


def restore(run: Letters, decoder: Decoder) -> tuple[list[str], list[int]]:
    """Restored words of a run, and the text each is in."""
    words, places = [], []
    for a, b, apart in run.suspects():
        for word in decoder.words(run.text[a:b], apart):
            words.append(word)
            places.append(a)
    return words, (np.searchsorted(run.bounds, np.array(places, np.int64), side="right") - 1).tolist()


def _hash_words(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of words (whole, and their beginnings), and the word each is of."""
    # Letter by letter over all words at once: words are short, so this takes as many steps as the longest has letters.
    state = np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64)
    out, owner = [], []
    length, at = ends - starts, np.arange(len(starts))
    step = 0
    while len(at):
        done = length[at] == step
        if done.any():
            out.append(mix(state[at[done]] + np.uint64(1)))
            owner.append(at[done])
            at = at[~done]
            if not len(at):
                break
        state[at] = mix(state[at] ^ letters[starts[at] + step].astype(np.uint64))
        step += 1
        if step in PREFIXES:
            out.append(mix(state[at] + np.uint64(100 + step)))
            owner.append(at)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out).view(np.int64), np.concatenate(owner)


def features(run: Letters, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of each text, its restored words included: (hash, text)."""
    starts, ends = run.spans(run.letters > 0)
    found, word = _hash_words(run.letters, starts, ends)
    text = np.searchsorted(run.bounds, starts, side="right")[word] - 1
    words, owners = restore(run, decoder)
    if words:
        sizes = np.array([len(w) for w in words])
        stops = np.cumsum(sizes)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
        more, which = _hash_words(points, stops - sizes, stops)
        found, text = np.concatenate([found, more]), np.concatenate([text, np.array(owners)[which]])
    return found, text


def _distinct(found: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[new], text[new]


def _feature_rows(batches: Iterator[pa.RecordBatch], model: LetterModel) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(model)
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for start, stop, data, bounds in text_runs(batch.column(0)):
            found, text = _distinct(*features(Letters(data, bounds), decoder))
            split = np.searchsorted(text, np.arange(stop - start + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(split, pa.int32()), pa.array(found)), pa.array(label[start:stop].astype(np.int32))],
                ["features", "toxic"],
            )


def _chosen_rows(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The same rows with the chosen features alone."""
    for batch in batches:
        column = batch.column(0)
        found = column.flatten().to_numpy()
        kept = _known(found, chosen) >= 0
        upto = np.concatenate([[0], np.cumsum(kept)])
        split = upto[column.offsets.to_numpy() - column.offsets[0].as_py()]
        features = pa.ListArray.from_arrays(pa.array(split, pa.int32()), pa.array(found[kept]))
        yield pa.RecordBatch.from_arrays([features, batch.column(1)], ["features", "toxic"])


def _known(found: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Place of each hash among the sorted `chosen` ones, -1 where it is none of them."""
    out = np.full(len(found), -1, np.int64)
    if len(chosen):
        low = np.zeros(1 << 16, bool)
        low[chosen & 0xFFFF] = True
        at = np.flatnonzero(low[found & 0xFFFF])
        place = np.minimum(np.searchsorted(chosen, found[at]), len(chosen) - 1)
        out[at] = np.where(chosen[place] == found[at], place, -1)
    return out


@dataclass
class LinearModel:
    chosen: np.ndarray  # feature hashes, sorted
    weights: np.ndarray
    bias: float


def _descend(place: np.ndarray, row: np.ndarray, label: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by scaled gradient steps on the whole sample."""
    weights = np.zeros(size + 1)
    rate = label.mean()
    weights[-1] = np.log(rate / (1 - rate))
    squares = np.zeros(size + 1)
    for _ in range(STEPS):
        score = np.bincount(row, weights=weights[place], minlength=len(label)) + weights[-1]
        error = 1 / (1 + np.exp(-score)) - label
        slope = np.zeros(size + 1)
        slope[:-1] = np.bincount(place, weights=error[row], minlength=size) + RIDGE * weights[:-1]
        slope[-1] = error.sum()
        squares += slope**2
        weights = weights - 0.5 * slope / np.sqrt(squares + 1e-8)
    return weights[:-1], float(weights[-1])


def fit_toxic(docs: DataFrame, labels: DataFrame, model: LetterModel, key: str = "doc_id", text: str = "text", bound: int = LABEL_BOUND) -> LinearModel:
    """The linear model from at most `bound` labelled documents (`toxic` 0 or 1), chosen by a hash of the key.

    Features are chosen by their log-likelihood ratio with the label, in Spark; the driver gets the
    chosen ones and which of them each labelled document has. Without both labels all scores are
    the rate of the label.
    """
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key")).agg(F.max("toxic").alias("_toxic"))
        .orderBy(F.xxhash64("_key"), "_key").limit(bound)
    )
    sample = docs.select(key, text).join(F.broadcast(known), F.col(key) == F.col("_key")).select(F.col(text), F.col("_toxic"))
    # Read and decoded once; the features of `bound` documents at most lie in the shared folder.
    rows = settled(sample.mapInArrow(lambda b: _feature_rows(b, model), "features array<long>, toxic int"), "toxic-features")
    count = rows.groupBy("toxic").count().toPandas().set_index("toxic")["count"]
    n1, n0 = int(count.get(1, 0)), int(count.drop(1, errors="ignore").sum())
    none = np.zeros(0, np.int64)
    if not n1 or not n0:
        rate = min(max(n1 / (n1 + n0) if n1 + n0 else 0.0, 1e-6), 1 - 1e-6)
        return LinearModel(none, np.zeros(0), float(np.log(rate / (1 - rate))))
    tally = (
        rows.select(F.explode("features").alias("feature"), F.col("toxic").cast("long").alias("toxic"))
        .groupBy("feature").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).filter("n > 2")
    )

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, n, total = F.col("a"), F.col("n"), float(n1 + n0)
    b = n - a
    ratio = 2 * (
        part(a, n * (n1 / total)) + part(b, n * (n0 / total))
        + part(n1 - a, (total - n) * (n1 / total)) + part(n0 - b, (total - n) * (n0 / total))
    )
    best = tally.withColumn("ratio", ratio).filter((F.col("ratio") >= LEAST_RATIO) & (a * total > n * n1))
    chosen = np.sort(best.orderBy(F.desc("ratio"), "feature").limit(FEATURES).select("feature").toPandas()["feature"].to_numpy(np.int64))
    held = rows.mapInArrow(lambda b: _chosen_rows(b, chosen), "features array<long>, toxic int").toPandas()
    lists = [np.asarray(f, np.int64) for f in held["features"]]
    row = np.repeat(np.arange(len(lists)), [len(f) for f in lists])
    place = _known(np.concatenate(lists) if lists else none, chosen)
    weights, bias = _descend(place, row, (held["toxic"] == 1).to_numpy(float), len(chosen))
    return LinearModel(chosen, weights, bias)


def _score(batches: Iterator[pa.RecordBatch], letters: LetterModel, model: LinearModel) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(letters)
    for batch in batches:
        out = []
        for start, stop, data, bounds in text_runs(batch.column(1)):
            found, text = features(Letters(data, bounds), decoder)
            place = _known(found, model.chosen)
            kept = place >= 0
            place, text = _distinct(place[kept], text[kept])
            total = np.bincount(text, weights=model.weights[place], minlength=stop - start) if len(place) else np.zeros(stop - start)
            out.append(1 / (1 + np.exp(-(total + model.bias))))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], [batch.schema.names[0], "score"]
        )


def score_toxic(docs: DataFrame, letters: LetterModel, model: LinearModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of every row, whole texts.

    Null and blank texts get the score of a text without features; repeated rows get equal rows; an
    empty table gives none; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(lambda batches: _score(batches, letters, model), f"`{key}` {kind}, score double")


def restored_words(texts: list[str], letters: LetterModel) -> pd.DataFrame:
    """What the decoder makes of some texts: (text number, restored word); for a look at a few texts."""
    decoder, out = Decoder(letters), []
    for start, _, data, bounds in text_runs(pa.array(texts, pa.string())):
        words, owners = restore(Letters(data, bounds), decoder)
        out += [(start + o, w) for w, o in zip(words, owners, strict=True)]
    return pd.DataFrame(out, columns=["text", "word"])
