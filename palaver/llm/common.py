"""What several operators share: byte views of Arrow texts, word positions and hashes, worker-wide state."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.session import fresh_path

CHUNK_BYTES = 1 << 20  # texts are worked on in runs of this many bytes; a longer text is a run of its own


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo the divisor; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % divisor


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that `df` does not have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def all_of(df: DataFrame) -> list[Column]:
    """Every column of `df`, whatever is in its name."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def settled(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: later work neither repeats it nor needs its executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_state(name: str) -> dict:
    """A dictionary that outlives the task in a Python worker; functions shipped by value lose their globals."""
    module = sys.modules.setdefault("palaver_worker_state", types.ModuleType("palaver_worker_state"))
    return module.__dict__.setdefault(name, {})


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; a null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, column.offset + len(column) + 1)[column.offset :] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def runs(bounds: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of at most `limit` bytes, or of one row."""
    start, rows = 0, len(bounds) - 1
    while start < rows:
        stop = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def text_runs(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, row after the last, bytes, bounds from 0) for each run of texts."""
    data, bounds = text_bytes(column)
    for start, stop in runs(bounds, limit):
        yield start, stop, data[bounds[start] : bounds[stop]], bounds[start : stop + 1] - bounds[start]


def byte_table(chars: str | bytes) -> np.ndarray:
    """Which of the 256 bytes are among `chars`."""
    table = np.zeros(256, bool)
    table[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return table


BLANKS = byte_table(bytes([0x20, *range(0x09, 0x0E)]))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `values` between successive bounds, empty ranges included."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Words:
    """Positions of the words in a run of texts; `breaks` says which bytes separate them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = BLANKS):
        inside = ~breaks[data]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        first = bounds[:-1][bounds[:-1] < bounds[1:]]
        before[first] = False  # a word ends with its text
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        after[first[1:] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.inside = inside
        self.bounds = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)


class Hasher:
    """64-bit hashes of byte ranges by prefix sums: every range of a run costs the same."""

    MULTIPLIER = 0x9E3779B97F4A7C15

    def __init__(self):
        self.values = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            def powers(base):
                out = np.full(size, base % (1 << 64), np.uint64)
                out[0] = 1
                return np.cumprod(out, dtype=np.uint64)

            self.powers, self.inverses = powers(self.MULTIPLIER), powers(pow(self.MULTIPLIER, -1, 1 << 64))

    def load(self, data: np.ndarray) -> None:
        self._grow(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=self.prefix[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.inverses[starts])
