"""Encoding whole texts with a public tokenizer, each distinct word once per Python worker.

The tokenizers split a text into words before they merge, and a word's ids do not depend on
its neighbours. Texts are cut at blanks, known words come from a table of the worker, and only
new words go to the library. Whatever could make a cut unsafe sends the whole text to the library.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from palaver.llm.common import worker_state

MAX_WORDS = 1 << 20  # words the table holds before it is thinned out
LONG_CHARS = 1 << 20  # longer texts are cut at safe blanks first
PART_CHARS = 1 << 22  # of the texts whose words are numbered together
JOINED = 1000  # new words encoded in one call
BREAK = "\n"
HEAD = "\0"  # marks a word at the start of a text or line, which has no blank before it
TAILS = ".,;:!?)]}\"%$&*#|"  # may follow a word; the library starts a new word there
ODD = re.compile(r"[^\S\n]|\u180e")
SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


class _Words:
    """Ids of known words: `at` finds a word's number; starts and lengths point into one array."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.hits = np.zeros(1 << 14, np.int32)  # runs of texts that found the word here
        self.used = 0

    def add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        number, end = len(self.at), self.used + len(ids)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while number + len(words) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        self.ids[self.used : end] = ids
        self.start[number : number + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.length[number : number + len(words)] = lengths
        self.used = end
        self.at.update(zip(words, range(number, number + len(words)), strict=True))

    def thinned(self, most: int) -> _Words:
        """A table of the words that were found again, at most so many: those found most often."""
        hits = self.hits[: len(self.at)]
        kept = np.flatnonzero(hits)
        if len(kept) > most:
            kept = np.sort(kept[np.argpartition(hits[kept], -most)[-most:]])
        words, out = list(self.at), _Words()
        out.add([words[k] for k in kept], self.gather(kept, self.length[kept]), self.length[kept])
        return out

    def gather(self, codes: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The ids of the words, one after the other; a word with length 0 here gives none."""
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[codes] - (ends - length), length) + np.arange(total)]


class WordEncoder:
    """`blanks` says whether a word's ids cover the blank before it (byte-level) or drop it."""

    def __init__(self, path: str, blanks: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.blanks = blanks
        self.words = _Words()
        vocabulary = self.library.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that open (or close) a word
        for piece, number in vocabulary.items():
            self.edge[number] = piece.startswith("Ġ") if blanks else piece.endswith("</w>")
        if blanks:
            self.newline = self._library([BREAK])[0][0]

    @staticmethod
    def shared(path: str, blanks: bool) -> WordEncoder:
        state = worker_state("word encoders")
        if path not in state:
            state[path] = WordEncoder(path, blanks)
        return state[path]

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _singly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._library(texts)
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _joined(self, words: list[str], headed: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for words of letters only, by one call for all of them if that can be told apart."""
        between = BREAK if headed and self.blanks else " "
        lead = " " if self.blanks and not headed else ""
        ids = np.array(self._library([lead + between.join(words)])[0], np.int64)
        if between == BREAK:
            at = np.flatnonzero(ids == self.newline)
            lengths = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
            ids = ids[ids != self.newline]
        elif self.blanks:
            lengths = np.diff(np.append(np.flatnonzero(self.edge[ids]), len(ids)))
        else:
            lengths = np.diff(np.append(-1, np.flatnonzero(self.edge[ids])))
        if len(lengths) == len(words) and lengths.sum() == len(ids):
            return ids, lengths
        return self._singly([lead + w for w in words])

    def _learn(self, words: set[str]) -> None:
        """Add words to the table; a known word with marks after it is put together from both."""
        known, split = self.words.at, {}
        letters = set(filter(str.isalpha, words))  # most words are nothing else
        wanted = set()
        for word in words - letters:
            base = word.rstrip(TAILS)
            if base != word and base and base[-1].lower().isalpha():
                tail = HEAD + word[len(base) :] if self.blanks else word[len(base) :]
                split[word] = base, tail
                wanted.add(base)
                wanted.add(tail)
            else:
                wanted.add(word)
        wanted = (wanted - letters).difference(known)
        plain: dict[bool, list[str]] = {False: [*letters], True: []}
        others = []
        for word in wanted:
            headed = self.blanks and word[:1] == HEAD
            if (word[1:] if headed else word).isalpha():
                plain[headed].append(word)
            else:
                others.append(word)
        for headed, some in plain.items():
            for k in range(0, len(some), JOINED):
                part = some[k : k + JOINED]
                self.words.add(part, *self._joined([w[headed:] for w in part], headed))
        if others:
            raw = [w[1:] if w[:1] == HEAD else w if w == BREAK else " " + w for w in others] if self.blanks else others
            self.words.add(others, *self._singly(raw))
        if split:
            codes = np.fromiter(map(known.__getitem__, chain.from_iterable(split.values())), np.int64, 2 * len(split))
            length = self.words.length[codes]
            self.words.add(list(split), self.words.gather(codes, length), length.reshape(-1, 2).sum(axis=1))

    def _unsafe(self, word: str) -> bool:
        """Whether a cut beside this word could differ from the library's own."""
        if not self.blanks or word == BREAK:
            return False
        word = word[1:] if word[:1] == HEAD else word
        return not word or word[0].isspace() or word[-1].isspace() or "᠎" in (word[0], word[-1])

    def _marked(self, text: str, first: bool) -> str:
        """The text as the words that a split at blanks gives: line ends are words, and what follows them is marked."""
        return (HEAD if first else "") + text.replace("\n", " \n " + HEAD) if self.blanks else text.replace("\n", " ")

    def _parts(self, text: str):
        start = 0
        while len(text) - start > LONG_CHARS:
            cut = SAFE.search(text, start + LONG_CHARS)
            if cut is None:
                break
            yield text[start : cut.start()], start == 0
            start = cut.end()
        yield text[start:], start == 0

    def _encode_part(self, texts: list[tuple[str, bool]]) -> list[np.ndarray]:
        if len(self.words.at) > MAX_WORDS:
            self.words = self.words.thinned(MAX_WORDS // 2)
        # Arrow splits and numbers the words; each distinct one is looked up once.
        cut = pc.split_pattern(pa.array([self._marked(text, first) for text, first in texts], pa.large_string()), " ")
        numbered = cut.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist
        known = np.fromiter(map(self.words.at.get, distinct, repeat(-1)), np.int64, len(distinct))
        self.words.hits[known[known >= 0]] += 1
        missing = np.flatnonzero(known < 0)
        if len(missing):
            unknown = [distinct[i] for i in missing.tolist()]
            # Other white space than blanks and line ends is rare; without it only an empty word is unsafe.
            odd = self.blanks and ODD.search("".join(unknown)) is not None
            unsafe = set(filter(self._unsafe, unknown)) if odd else {"", HEAD} if self.blanks else set()
            self._learn(set(unknown) - unsafe)
            known[missing] = np.fromiter(map(self.words.at.get, unknown, repeat(-1)), np.int64, len(unknown))
        codes = known[numbered.indices.to_numpy()]
        bad = codes < 0
        codes[bad] = 0
        length = np.where(bad, 0, self.words.length[codes])
        ids = self.words.gather(codes, length)
        bounds = cut.offsets.to_numpy()
        ends = np.concatenate([[0], np.cumsum(length)])
        wrong = np.concatenate([[0], np.cumsum(bad)])
        out = []
        for k, (text, first) in enumerate(texts):
            a, b = bounds[k], bounds[k + 1]
            if wrong[a] == wrong[b] and not (self.blanks and HEAD in text):
                out.append(ids[ends[a] : ends[b]])
            else:
                whole = text if first or not self.blanks else " " + text
                out.append(np.array(self._library([whole])[0], np.uint32))
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as the library gives them without added tokens; null counts as empty."""
        parts, owners = [], []
        for k, text in enumerate(texts):
            for part in self._parts(text) if text else ():
                parts.append(part)
                owners.append(k)
        out: list = [[] for _ in texts]
        k = 0
        while k < len(parts):
            held, stop = 0, k
            while stop < len(parts) and held < PART_CHARS:
                held += len(parts[stop][0])
                stop += 1
            for owner, ids in zip(owners[k:stop], self._encode_part(parts[k:stop]), strict=True):
                out[owner].append(ids)
            k = stop
        empty = np.zeros(0, np.uint32)
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else empty for p in out]
