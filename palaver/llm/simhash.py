"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Texts become fingerprints in one pass without a shuffle, and equal fingerprints are collapsed at
once. Fingerprints within `radius` bits agree on at least one of `radius + 1` bit blocks, so each
one is dealt to one bucket per block and no pair within the radius is lost. A bucket is sorted by
bit count and cut into tiles of bounded size; every pair of tiles whose bit counts can be within
the radius is compared whole with exclusive-or and bit counts, in a task of its own for large
buckets. A tile pair emits a spanning forest of its links, never all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import Words, all_of, settled, spare, text_runs
from palaver.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
TILE = 1024
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _fingerprint(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per range of hashes: each bit that is set in over half of them."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    # Bits of the hashes in eight bytes, low byte first; counted in runs, so a long text needs little memory.
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        counts = np.zeros(64, np.int64)
        for start in range(a, b, 1 << 14):
            part = hashes[start : min(b, start + (1 << 14))]
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if b > a:
            out[k] = np.packbits(2 * counts > b - a, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    digest = xxhash.xxh64_intdigest
    for batch in batches:
        out = []
        for _, _, data, bounds in text_runs(batch.column(0)):
            words = Words(data, bounds)
            # The words in lower case with one blank after each: a shingle is then one slice.
            lengths = words.ends - words.starts
            at = np.cumsum(lengths + 1) - lengths - 1
            joined = np.full(int((lengths + 1).sum()), 32, np.uint8)
            text = np.flatnonzero(words.inside)
            joined[np.arange(len(text)) + np.repeat(np.arange(len(lengths)), lengths)] = LOWER[data[text]]
            joined = joined.tobytes()
            shingles = np.maximum(words.counts - size + 1, np.minimum(words.counts, 1))
            owner = np.repeat(np.arange(len(shingles)), shingles)
            ends = np.concatenate([[0], np.cumsum(shingles)])
            first = words.bounds[:-1][owner] + np.arange(ends[-1]) - ends[:-1][owner]
            last = np.minimum(first + size, words.bounds[1:][owner]) - 1
            hashes = np.fromiter(
                (digest(joined[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last] + lengths[last]).tolist(), strict=True)),
                np.uint64, len(first),
            )
            out.append(_fingerprint(hashes, ends).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))],
            [*batch.schema.names[1:], "print"],
        )


def simhash(docs: DataFrame, keys: list[str], text: str = "text", size: int = SHINGLE) -> DataFrame:
    """`keys` and `print` (the fingerprint as a long) of every row; blank and null texts have print 0."""
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(text, *keys).mapInArrow(lambda batches: fingerprints(batches, size), f"{kinds}, print long")


def _forest(left: np.ndarray, right: np.ndarray, radius: int, own: bool) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between two tiles, as indices into each; `own`: the same tile twice.

    Instead of all links, each row of a component is linked once: rows are taken up breadth-first.
    """
    near = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
    if own:
        np.fill_diagonal(near, False)
    rows, free = np.ones(len(left), bool), np.ones(len(right), bool)
    a, b = [], []
    for seed in np.flatnonzero(near.any(axis=1)):
        if not rows[seed]:
            continue
        rows[seed] = False
        if own:
            free[seed] = False
        todo = [(seed, True)]
        while todo:
            at, of_left = todo.pop()
            met = np.flatnonzero(near[at] & free if of_left else near[:, at] & rows)
            if of_left:
                free[met] = False
                if own:
                    rows[met] = False
            else:
                rows[met] = False
            a += [at] * len(met) if of_left else met.tolist()
            b += met.tolist() if of_left else [at] * len(met)
            todo += [(m, own or not of_left) for m in met.tolist()]
    return a, b


def _compare(tiles: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    for frame in tiles:
        a, b = [], []
        for left, right, own in zip(frame["left"], frame["right"], frame["own"], strict=True):
            left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
            i, j = _forest(left.view(np.uint64), right.view(np.uint64), radius, own)
            a.append(left[i])
            b.append(right[j])
        yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)} if a else {"a": [], "b": []}, dtype="int64")


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links between the distinct fingerprints in column `print`.

    They connect what all links within `radius` bits connect, and every one is such a link.
    """
    edges = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    value = F.array(*(
        F.shiftrightunsigned(F.shiftleft("print", 64 - stop), 64 - stop + start)
        for start, stop in zip(edges, edges[1:], strict=False)
    ))
    dealt = prints.select("print", F.bit_count("print").alias("bits"), F.posexplode(value).alias("block", "value"))
    bucket = ["block", "value"]
    # Per bucket, how many tiles each bit count needs: at most 65 entries.
    counts = dealt.groupBy(*bucket, "bits").agg(F.count("*").alias("n"))
    needs = (
        counts.groupBy(*bucket)
        .agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("bits", F.ceil(F.col("n") / tile)))).alias("tiles"))
        .filter("n > 1").select(*bucket, "tiles")
    )
    slices = F.col("tiles")[F.col("bits")]
    tiles = settled(
        dealt.join(needs, bucket)
        .select(*bucket, "bits", F.pmod(F.xxhash64("print"), slices).alias("slice"), "print", "tiles")
        .groupBy(*bucket, "bits", "slice")
        .agg(F.collect_list("print").alias("prints"), F.first("tiles").alias("tiles")),
        "simhash-tiles",
    )
    # A tile meets itself, the later tiles of its bit count and all tiles of the next `radius` counts.
    def later(more: int) -> Column:
        there = F.col("tiles")[F.col("bits") + more]
        start = F.col("slice") if more == 0 else F.lit(0).cast("long")
        at = F.transform(
            F.sequence(start, there - 1), lambda i: F.struct((F.col("bits") + more).alias("bits"), i.alias("slice"))
        )
        return F.when(there.isNotNull(), at).otherwise(F.array().cast("array<struct<bits:int,slice:bigint>>"))

    met = F.flatten(F.array(*(later(more) for more in range(radius + 1))))
    left = tiles.select(*bucket, F.col("prints").alias("left"), "bits", "slice", F.explode(met).alias("to")).select(
        *bucket, "left", F.col("to.bits").alias("bits"), F.col("to.slice").alias("slice"),
        ((F.col("to.bits") == F.col("bits")) & (F.col("to.slice") == F.col("slice"))).alias("own"),
    )
    right = tiles.select(*bucket, "bits", "slice", F.col("prints").alias("right"))
    pairs = left.join(right, [*bucket, "bits", "slice"]).filter(~F.col("own") | (F.size("left") > 1))
    return pairs.select("left", "right", "own").mapInPandas(lambda frames: _compare(frames, radius), "a long, b long")


def classes(
    docs: DataFrame, keys: list[str], first: Column, text: str = "text", size: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """`keys`, `print` and `first` of every row: its fingerprint, and the least value of `first` in its class.

    `first` is an expression over `keys`. A class holds what chains of links within `radius` bits
    connect; equal fingerprints always share a class, so blank and null texts (fingerprint 0) do.
    Repeated rows stay and get equal rows; an empty table gives none.
    """
    rows = settled(simhash(docs, keys, text, size), "simhash-prints")
    prints = rows.groupBy("print").agg(F.min(first).alias("first"))
    member = components(links(prints, radius))
    rooted = prints.join(member, F.col("print") == F.col("node"), "left").select(
        "print", "first", F.coalesce("component", "print").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rows.join(rooted.select("print", "root").join(least, "root").select("print", "first"), "print")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id (the class's smallest key; null keys only count if all are)."""
    return classes(docs, [key], F.col(key), text, size, radius).select(
        key, F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id")
    )


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` with the smallest key of their class (a null key last), one of each class, all columns."""
    # Two hashes of the whole row stand for it: equal rows are one document. Only they meet in the
    # join, whose partitioning and order then also serve to drop repeated rows: one shuffle of texts.
    row, other, none, least = spare(docs, "_row", "_other", "_none", "_key")
    hashable = [c for c, f in zip(all_of(docs), docs.schema.fields, strict=True) if "map<" not in f.dataType.simpleString()]
    hashed = docs.withColumns({row: F.xxhash64(*hashable), other: F.xxhash64(F.lit(1), *hashable)})
    rank = F.struct(F.col(key).isNull().alias(none), F.col(key).alias(least), row, other)
    chosen = classes(hashed, [key, row, other], rank, text, size, radius).select(f"first.{row}", f"first.{other}").distinct()
    return hashed.join(chosen, [row, other], "left_semi").dropDuplicates([row, other]).select(*all_of(docs))
