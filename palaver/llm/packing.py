"""Sequence packing by Karmarkar-Karp multiway differencing.

Documents are cut into whole windows and a rest; rests into pieces of bounded size and a small one. A
group of pieces is parted into windows of nearly equal length: every piece starts as a partial
partition with one filled slot, and the two partitions with the largest imbalance are merged,
largest slots of one with smallest slots of the other, until one is left. If a window then
exceeds the capacity, the group gets one window more and starts again.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from palaver.llm.encoders import WordEncoder
from palaver.llm.token_counts import public_path

MODEL = "word_bpe_49k.json"
END = 1
CAPACITY = 2048
PIECE = 1024  # the rest of a document is cut into pieces of at most this length
SMALL = (16, 49)  # and one small piece, of 16 to 64 ids, which lets differencing even out the windows
GROUP = 2048  # pieces that are parted together
TEXT_RUN = 400


def _members(node) -> list[int]:
    out, todo = [], [node]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            todo += node
        else:
            out.append(node)
    return out


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Part the indices of `sizes` into at most `ways` lists with nearly equal sums."""
    # A partial partition: its filled slots as (sum, members), largest first; the other slots are empty.
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    ticket = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = max(0, len(a) + len(b) - ways)
        slots = a[: len(a) - over] + b[: len(b) - over]
        slots += [
            (x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)
        ]
        slots.sort(key=lambda slot: -slot[0])
        spread = slots[0][0] - (slots[-1][0] if len(slots) == ways else 0)
        heapq.heappush(heap, (-spread, ticket, slots))
        ticket += 1
    return [_members(node) for _, node in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows that differencing fills without exceeding the capacity, counting up."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, ways)
        if all(sum(sizes[i] for i in part) <= capacity for part in parts):
            return parts
        ways += 1


def cuts(length: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[int]:
    """Lengths of a document's pieces: whole windows, equal pieces of at most `piece`, a small piece."""
    whole, rest = divmod(length, capacity)
    small = min(rest, SMALL[0] + rest % SMALL[1])
    rest -= small
    parts = -(-rest // piece)
    return [capacity] * whole + [rest // parts + (k < rest % parts) for k in range(parts)] + [small] * (small > 0)


FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(batches: Iterator[pa.RecordBatch], locate, end: int, capacity: int, group: int, name: str):
    encoder = WordEncoder.shared(locate(), blanks=False)
    sequence = TaskContext.get().partitionId() << 33
    close, waiting, kind = np.array([end], np.uint32), [], None

    def rows(out):
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])],
            [name, *(f.split()[0] for f in FIELDS.split(", "))],
        )

    def parted(pieces):
        nonlocal sequence
        out = []
        for part in windows([p[2] for p in pieces], capacity):
            offset = 0
            for i in part:
                out.append((*pieces[i], sequence, offset))
                offset += pieces[i][2]
            sequence += 1
        return out

    for batch in batches:
        kind, out = batch.column(0).type, []
        for first in range(0, len(batch), TEXT_RUN):
            some = batch.slice(first, TEXT_RUN)
            for key, got in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                ids, start = np.concatenate([got, close]), 0
                for length in cuts(len(ids), capacity):
                    piece = (key, start, length, zlib.crc32(ids[start : start + length]), len(ids))
                    start += length
                    if length == capacity:
                        out.append((*piece, sequence, 0))
                        sequence += 1
                    else:
                        waiting.append(piece)
            while len(waiting) >= group:
                out += parted(waiting[:group])
                waiting = waiting[group:]
        if out:
            yield rows(out)
    if waiting:
        yield rows(parted(waiting))


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, end: int = END,
    capacity: int = CAPACITY, group: int = GROUP,
) -> DataFrame:
    """Pieces of all rows placed in sequences of at most `capacity` ids.

    Columns: key, start (the document's ids before the piece), length, ids_crc32, doc_tokens,
    sequence_id, offset (place in the sequence, without gaps). Every id, `end` included, lies in
    one piece. A null text counts as empty and gives one piece with `end`; repeated rows are all
    packed; an empty table gives no rows; a very long text becomes whole windows and a rest. Groups
    form inside a task, in the order of its rows, so nothing is shuffled; the last group of a task
    is smaller. Sequence ids are unique: task number times 2^33 plus a counter.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        lambda batches: _pack(batches, lambda: public_path(model), end, capacity, group, key),
        f"`{key}` {kind}, {FIELDS}",
    )
