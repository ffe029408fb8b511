"""Token ids in wavelet-matrix shards: one compressed body per shard answers access, rank and select.

A wavelet matrix keeps one bit plane per bit of an id. On each level ids are split, in order,
into those with a 0 and those with a 1 in that bit, zeros first; counts of ones per block make
rank on a plane a table look-up. Shards are rows of a Parquet table, so any store that Spark
writes to can hold them, and executors never see each other's local files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.encoders import WordEncoder
from palaver.llm.token_counts import public_path

MODEL = "byte_bpe_50k.json"
END = 2  # id that closes every document
SHARD_TOKENS = 1 << 18
BLOCK = 512  # bits per entry of the rank directory
MAGIC = b"WVMX"
HEADER = "<4sQBQ"  # magic, ids, planes, bytes of the body when unpacked
TEXT_RUN = 2000  # rows encoded together


class WaveletMatrix:
    """Ids as bit planes, most significant bit first."""

    def __init__(self, size: int, planes: list[np.ndarray], directories: list[np.ndarray]):
        self.size, self.planes, self.directories = size, planes, directories  # planes: bytes, low bit first
        self.zeros = [size - int(d[-1]) for d in directories]
        self._directories: dict[tuple[int, bool], np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.asarray(ids, np.uint32)
        levels, size = max(1, int(ids.max(initial=0)).bit_length()), len(ids)
        kind = np.uint16 if levels <= 16 else np.uint32
        # Two buffers take turns: each level is split from one into the other.
        ids, after = ids.astype(kind), np.empty(size, kind)
        planes, directories = [], []
        for level in range(levels - 1, -1, -1):
            one = (ids & kind(1 << level)).astype(bool)
            plane = np.packbits(one, bitorder="little")
            padded = np.zeros(-(-max(size, 1) // BLOCK) * BLOCK // 8, np.uint8)
            padded[: len(plane)] = plane
            planes.append(padded)
            ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1)
            directories.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32))
            zeros = size - int(directories[-1][-1])
            np.compress(one, ids, out=after[zeros:])
            np.logical_not(one, out=one)
            np.compress(one, ids, out=after[:zeros])
            ids, after = after, ids
        return cls(size, planes, directories)

    def to_bytes(self) -> bytes:
        body = b"".join(p.tobytes() for p in self.planes) + b"".join(d.tobytes() for d in self.directories)
        packed = pa.compress(body, codec="zstd", asbytes=True)
        return struct.pack(HEADER, MAGIC, self.size, len(self.planes), len(body)) + packed

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, size, levels, length = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        body = pa.decompress(memoryview(data)[struct.calcsize(HEADER) :], decompressed_size=length, codec="zstd", asbytes=True)
        blocks = -(-max(size, 1) // BLOCK)
        wide = blocks * BLOCK // 8
        planes = [np.frombuffer(body, np.uint8, wide, k * wide) for k in range(levels)]
        directories = [
            np.frombuffer(body, np.uint32, blocks + 1, levels * wide + 4 * k * (blocks + 1)) for k in range(levels)
        ]
        return cls(size, planes, directories)

    def _ones(self, level: int, at: int) -> int:
        """Ones before position `at` on a level."""
        block, rest = divmod(at, BLOCK)
        ones = int(self.directories[level][block])
        if rest:
            part = self.planes[level][block * BLOCK // 8 : block * BLOCK // 8 + -(-rest // 8)]
            ones += int(np.unpackbits(part, bitorder="little")[:rest].sum())
        return ones

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.size:
            raise IndexError(at)
        value = 0
        for level, plane in enumerate(self.planes):
            one = plane[at >> 3] >> (at & 7) & 1
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if one else at - ones
            value = value << 1 | int(one)
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        """Where the token's occurrences between two positions lie after the last level."""
        if token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, start), self._ones(level, stop)
            if token >> (len(self.planes) - 1 - level) & 1:
                start, stop = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def rank(self, token: int, stop: int) -> int:
        """Occurrences of the token before position `stop`."""
        a, b = self._range(token, 0, min(stop, self.size))
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def _before(self, level: int, one: bool) -> np.ndarray:
        """How many ones (or zeros) lie before each block of a level; worked out once."""
        key = level, one
        if key not in self._directories:
            ones = self.directories[level].astype(np.int64)
            self._directories[key] = ones if one else np.arange(len(ones)) * BLOCK - ones
        return self._directories[key]

    def _find(self, level: int, numbers: np.ndarray, one: bool) -> np.ndarray:
        """Positions of the bits (ones or zeros) with `numbers` like them before, on a level."""
        if len(numbers) * BLOCK > self.size:  # so many that looking through the whole plane is less work
            bits = np.unpackbits(self.planes[level], count=self.size, bitorder="little").view(bool)
            return np.flatnonzero(bits if one else ~bits)[numbers]
        before = self._before(level, one)
        block = np.searchsorted(before, numbers, side="right") - 1
        bits = np.unpackbits(self.planes[level].reshape(-1, BLOCK // 8)[block], axis=1, bitorder="little")
        upto = np.cumsum(bits == one, axis=1, dtype=np.int32)
        return block * BLOCK + (upto > (numbers - before[block])[:, None]).argmax(axis=1)

    def _up(self, token: int, places: np.ndarray) -> np.ndarray:
        """Positions of a token's occurrences from their places after the last level."""
        for level in range(len(self.planes) - 1, -1, -1):
            one = bool(token >> (len(self.planes) - 1 - level) & 1)
            places = self._find(level, places - self.zeros[level] if one else places, one)
        return places

    def select(self, token: int, number: int) -> int:
        """Position of the occurrence with `number` occurrences before it."""
        start, stop = self._range(token, 0, self.size)
        if not 0 <= number < stop - start:
            raise IndexError(number)
        return int(self._up(token, np.array([start + number]))[0])

    def places(self, token: int) -> np.ndarray:
        """Positions of all occurrences, in order: one pass per level for all of them."""
        return self._up(token, np.arange(*self._range(token, 0, self.size)))

    def positions(self, token: int) -> list[int]:
        return self.places(token).tolist()

    def decode(self) -> np.ndarray:
        """All ids in order: the splits undone from the last level up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        ids, merged = np.zeros(self.size, kind), np.empty(self.size, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.size, bitorder="little").view(bool)
            ids[self.zeros[level] :] |= kind(1 << (len(self.planes) - 1 - level))
            merged[np.flatnonzero(one)] = ids[self.zeros[level] :]
            np.logical_not(one, out=one)
            merged[np.flatnonzero(one)] = ids[: self.zeros[level]]
            ids, merged = merged, ids
        return ids.astype(np.uint32)


def _encode(batches: Iterator[pa.RecordBatch], locate, end: int, size: int) -> Iterator[pa.RecordBatch]:
    encoder, part, shard = WordEncoder.shared(locate(), blanks=True), TaskContext.get().partitionId(), 0
    keys, lengths, ids, held = [], [], [], 0
    close, names = np.array([end], np.uint32), None

    def written(kind):
        whole = np.concatenate(ids)
        body = WaveletMatrix.build(whole).to_bytes()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([held], pa.int64()),
                pa.array([whole.min()], pa.int64()), pa.array([whole.max()], pa.int64()),
                pa.array([keys], pa.list_(kind)), pa.array([lengths], pa.list_(pa.int64())), pa.array([body], pa.binary()),
            ],
            names=["part", "shard", "n_ids", "least", "greatest", "keys", "lengths", "body"],
        )

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for start in range(0, len(batch), TEXT_RUN):
            some = batch.slice(start, TEXT_RUN)
            for key, got in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                keys.append(key)
                lengths.append(len(got) + 1)
                ids += [got, close]
                held += len(got) + 1
                if held >= size:
                    yield written(kind)
                    keys, lengths, ids, held, shard = [], [], [], 0, shard + 1
    if keys:
        yield written(kind)


def write_shards(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", model: str = MODEL, end: int = END, size: int = SHARD_TOKENS
) -> None:
    """Write the ids of all rows, ordered by key and then by a hash of the text, to a new table of shards.

    A shard closes with the document that reaches `size` ids; a very long text makes a shard of
    its own. A null text counts as empty and gives `end` alone; null keys come first; repeated rows
    are all written; an empty table gives a table without rows. A hot key is split by the hash.
    """
    kind = docs.schema[key].dataType.simpleString()
    order = [F.col(key), F.xxhash64(text)]
    (
        docs.select(key, text).repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(
            lambda batches: _encode(batches, lambda: public_path(model), end, size),
            f"part int, shard int, n_ids long, least long, greatest long, keys array<{kind}>, lengths array<long>, body binary",
        )
        .write.option("compression", "zstd").parquet(path)
    )


def _decode(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            keys, lengths, body, at = (batch.column(k)[row] for k in range(4))
            ids = WaveletMatrix.from_bytes(body.as_py()).decode()
            sizes = lengths.values.to_numpy()
            ends = np.cumsum(sizes)
            starts = ends - sizes
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [keys.values, pa.array(starts + at.as_py()), pa.array(sizes), pa.array(sums, pa.int64())],
                [name, "start", "n_tokens", "ids_crc32"],
            )


def read_documents(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before), n_tokens, ids_crc32 of every document in the shards.

    Where a shard starts follows from sums: over the parts (one row per writing task) and over the
    shards of a part.
    """
    kind = shards.schema["keys"].dataType.elementType.simpleString()
    sizes = shards.select("part", "shard", "n_ids")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))
        .withColumn("first", F.coalesce(F.sum("ids").over(before.orderBy("part")), F.lit(0)))
    )
    within = F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("shard")), F.lit(0))
    starts = sizes.withColumn("within", within).join(parts.select("part", "first"), "part")
    placed = shards.join(starts.select("part", "shard", (F.col("first") + F.col("within")).alias("at")), ["part", "shard"])
    return placed.select("keys", "lengths", "body", "at").mapInArrow(
        lambda batches: _decode(batches, key), f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long"
    )


def _may_hold(tokens: list[int]):
    """Whether a shard's least and greatest id leave room for one of the tokens; Spark checks it against row-group bounds."""
    held = F.lit(False)
    for token in sorted(set(tokens)):
        held = held | ((F.col("least") <= token) & (F.col("greatest") >= token))
    return held


def _counts(batches: Iterator[pa.RecordBatch], tokens: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in batch.column(0):
            shard = WaveletMatrix.from_bytes(body.as_py())
            found = [shard.count(token) for token in tokens]
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(found, pa.int64())], ["token", "n"])


def count_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of the ids occurs in all shards, by rank on their planes; an id that never occurs has n 0.

    A negative id, or one beyond the vocabulary, never occurs. Only shards whose bounds leave room
    for one of the ids are opened.
    """
    asked = sorted(set(tokens))
    listed = shards.sparkSession.createDataFrame([(t,) for t in asked], "token long")
    fitting = [t for t in asked if t >= 0]
    found = shards.filter(_may_hold(fitting)).select("body").mapInArrow(lambda batches: _counts(batches, fitting), "token long, n long")
    sums = found.groupBy("token").agg(F.sum("n").alias("n"))
    return listed.join(sums, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def _places(batches: Iterator[pa.RecordBatch], token: int, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            keys, lengths, body = (batch.column(k)[row] for k in range(3))
            at = WaveletMatrix.from_bytes(body.as_py()).places(token)
            ends = np.cumsum(lengths.values.to_numpy())
            owner = np.searchsorted(ends, at, side="right")
            starts = ends - lengths.values.to_numpy()
            yield pa.RecordBatch.from_arrays([keys.values.take(pa.array(owner)), pa.array(at - starts[owner])], [name, "at"])


def occurrences(shards: DataFrame, token: int, key: str = "doc_id") -> DataFrame:
    """(key, at): every occurrence of an id, as its document and its place among the document's ids, by select on the planes.

    Shards whose bounds leave no room for the id are not opened. Rows of one key that were written
    as several documents give places in each.
    """
    kind = shards.schema["keys"].dataType.elementType.simpleString()
    held = shards.filter(_may_hold([token]) if token >= 0 else F.lit(False))
    return held.select("keys", "lengths", "body").mapInArrow(lambda batches: _places(batches, token, key), f"`{key}` {kind}, at long")
