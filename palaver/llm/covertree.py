"""Embedding near-duplicates: exact links within a distance by dual traversal of cover trees.

Unit vectors within a cosine are those within a distance, so the vectors of a label can be held by
cover trees. Copies of a vector are one point with a weight. The points of a label are dealt to
cells level by level, each time to the nearest of a few pivots of their cell, until a cell holds
a bounded number; a cell's points then form one cover tree, built in one task: nested levels of
centres whose radius halves from level to level, every centre with the measured radius of what it
covers. Pairs of trees are found by walking the cells of a label against each other from the top,
and two trees are walked against each other in one task. A pair of nodes is dropped where the
distance of the centres less both radii is over the limit, and linked as a whole where the
distance and both radii are within it; what is left are pairs of points, compared exactly. A pair
of trees emits how many links each point has and a spanning forest of them, never all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import all_of, settled
from palaver.llm.components import components

COSINE = 0.93
CELL = 8192  # points of a tree at most, as hashes deal them; fewer where vectors are long
COMPONENTS = 1 << 20  # numbers in the vectors of a tree
PIVOTS = 64  # pivots of a cell that is divided
DIVISIONS = 8  # levels of division; a cell that is still too large is cut by a hash
GROUP = 64  # candidates for centres that are looked at together
PAIRS = 1 << 16  # pairs whose vectors are gathered at once
TILE = 1024  # rows and columns of a block of distances
EDGES = 1 << 20  # edges held before they are cut down to a forest
SLACK = 1e-7  # what rounding may do to a distance: bounds give way by it, cosines do not


# --- in a task: one tree, two trees -------------------------------------------------------------------


def _apart(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


class CoverTree:
    """Points in tree order with the nodes over them.

    Node k covers the points lo[k] to hi[k]; its centre is point lo[k] and radius[k] the greatest
    distance from it. Its children are the nodes first[k] to last[k] (none: a leaf, whose points
    are all within rounding of each other).
    """

    FIELDS = ("order", "lo", "hi", "radius", "first", "last")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        """Children lie on the next level that parts a node's points: centres more than the level's radius apart, the node's own first."""
        order = np.arange(len(points))
        lo, hi, reach, radius, first, last = [0], [len(points)], [2.0], [], [], []
        at = 0
        while at < len(lo):
            members = order[lo[at] : hi[at]].copy()
            away = _apart(points[members] @ points[members[0]])
            away[0] = 0.0
            radius.append(float(away.max()))
            first.append(len(lo))
            if radius[at] > SLACK:
                half = reach[at] / 2
                while half >= radius[at]:  # levels on which the node would be its only child
                    half /= 2
                start = lo[at]
                while len(members):
                    some = members[:GROUP]
                    near = _apart(points[some] @ points[some].T) <= half
                    chosen: list[int] = []
                    for k in range(len(some)):
                        if not near[k, chosen].any():
                            chosen.append(k)
                    covered = _apart(points[some[chosen]] @ points[members].T) <= half
                    covered[np.arange(len(chosen)), chosen] = True
                    owner = np.where(covered.any(axis=0), covered.argmax(axis=0), -1)
                    owner[chosen] = np.arange(len(chosen))
                    for k, c in enumerate(chosen):
                        mine = np.flatnonzero(owner == k)
                        mine = members[np.concatenate([[c], mine[mine != c]])]
                        order[start : start + len(mine)] = mine
                        lo.append(start)
                        start += len(mine)
                        hi.append(start)
                        reach.append(half)
                    members = members[owner < 0]
            last.append(len(lo))
            at += 1
        kinds = (np.int64, np.int64, np.int64, np.float64, np.int64, np.int64)
        return cls(**{f: np.array(v, k) for f, v, k in zip(cls.FIELDS, (order, lo, hi, radius, first, last), kinds, strict=True)})


def _products(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, a, b) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) for all i in x[k] to x[k] + nx[k] and j in y[k] to y[k] + ny[k], for every k, some at a time."""
    size = nx * ny
    for k in np.flatnonzero(size > TILE):
        for s in range(x[k], x[k] + nx[k], TILE):
            i = np.arange(s, min(s + TILE, x[k] + nx[k]))
            left = a(i)
            for t in range(y[k], y[k] + ny[k], TILE):
                j = np.arange(t, min(t + TILE, y[k] + ny[k]))
                yield np.repeat(i, len(j)), np.tile(j, len(i)), (left @ b(j).T).ravel()
    small = np.flatnonzero(size <= TILE)
    for s in range(0, len(small), PAIRS // TILE):
        k = small[s : s + PAIRS // TILE]
        spot = np.arange(size[k].sum()) - np.repeat(np.cumsum(size[k]) - size[k], size[k])
        width = np.repeat(ny[k], size[k])
        i, j = np.repeat(x[k], size[k]) + spot // width, np.repeat(y[k], size[k]) + spot % width
        yield i, j, np.einsum("nd,nd->n", a(i), b(j))


class Links:
    """How many links the points of two trees have, and a forest of them; places are those of the left tree, then of the right."""

    def __init__(self, size: int):
        self.size, self.count, self.steps = size, np.zeros(size, np.int64), np.zeros(size + 1, np.int64)
        self.a, self.b, self.held = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > EDGES:
            a, b = self.forest()
            self.a, self.b, self.held = [a], [b], len(a)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges from each point to the first one that it is connected with."""
        root = np.arange(self.size)
        if self.a:
            a, b = np.concatenate(self.a), np.concatenate(self.b)
            while True:
                low = np.minimum(root[a], root[b])
                after = root.copy()
                np.minimum.at(after, root[a], low)
                np.minimum.at(after, root[b], low)
                while not np.array_equal(after, after[after]):
                    after = after[after]
                if np.array_equal(after, root):
                    break
                root = after
        linked = np.flatnonzero(root != np.arange(self.size))
        return linked, root[linked]

    def total(self) -> np.ndarray:
        return self.count + np.cumsum(self.steps)[:-1]


def traverse(left: CoverTree, a: np.ndarray, wa: np.ndarray, right: CoverTree, b: np.ndarray, wb: np.ndarray, cosine: float, own: bool) -> Links:
    """Walk two trees against each other (`own`: a tree with itself); `a`, `b` are points and `wa`, `wb` weights in tree order.

    A point's links are counted by the weights of the points it is linked with.
    """
    limit, base = math.sqrt(2 - 2 * cosine), 0 if own else len(a)
    found = Links(len(a) if own else len(a) + len(b))
    before_a, before_b = (np.concatenate([[0], np.cumsum(w)]) for w in (wa, wb))

    def ranges(starts: np.ndarray, stops: np.ndarray, add: np.ndarray) -> None:
        np.add.at(found.steps, starts, add)
        np.add.at(found.steps, stops, -add)

    def whole(i: np.ndarray, j: np.ndarray) -> None:
        """Every point of node i is linked with every point of node j; within one node, with all others."""
        same = (i == j) if own else np.zeros(len(i), bool)
        ranges(left.lo[i], left.hi[i], before_b[right.hi[j]] - before_b[right.lo[j]])
        for k in i[same]:
            found.count[left.lo[k] : left.hi[k]] -= wa[left.lo[k] : left.hi[k]]
        p, q = i[~same], j[~same]
        ranges(base + right.lo[q], base + right.hi[q], before_a[left.hi[p]] - before_a[left.lo[p]])
        # Every point is linked with the other node's centre: that connects them all.
        for lo, hi, shift, centre in ((left.lo[i], left.hi[i], 0, base + right.lo[j]), (right.lo[j], right.hi[j], base, left.lo[i])):
            size = hi - lo
            for s in range(0, len(size), TILE):
                n = size[s : s + TILE]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[s : s + TILE], n)
                found.add(shift + at, np.repeat(centre[s : s + TILE], n))

    def points(i: np.ndarray, j: np.ndarray) -> None:
        for x, y, cos in _products(left.lo[i], left.hi[i] - left.lo[i], right.lo[j], right.hi[j] - right.lo[j], a.__getitem__, b.__getitem__):
            hit = cos >= cosine
            if own:  # within one leaf each pair is met twice, and each point meets itself
                hit &= (x != y) & ((x < y) | (np.searchsorted(edges, x, "right") != np.searchsorted(edges, y, "right")))
            x, y = x[hit], y[hit]
            np.add.at(found.count, x, wb[y])
            np.add.at(found.count, base + y, wa[x])
            found.add(x, base + y)

    leaf_a, leaf_b = left.first == left.last, right.first == right.last
    edges = np.sort(left.lo[leaf_a])
    # A leaf stays itself while the other node is opened.
    open_a, many_a = np.where(leaf_a, np.arange(len(leaf_a)), left.first), np.where(leaf_a, 1, left.last - left.first)
    open_b, many_b = np.where(leaf_b, np.arange(len(leaf_b)), right.first), np.where(leaf_b, 1, right.last - right.first)
    todo: list[tuple[np.ndarray, np.ndarray]] = []

    def judge(i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> None:
        far, both = _apart(cos), left.radius[i] + right.radius[j]
        near = far <= limit + both + SLACK
        i, j, far, both = i[near], j[near], far[near], both[near]
        if own:
            far = np.where(i == j, 0.0, far)
        ends, one = leaf_a[i] & leaf_b[j], (left.hi[i] - left.lo[i] == 1) & (right.hi[j] - right.lo[j] == 1)
        within = (far + both <= limit - SLACK) & ~one
        whole(i[within], j[within])
        points(i[ends & ~within], j[ends & ~within])
        if not (rest := ~within & ~ends).any():
            return
        todo.append((i[rest], j[rest]))

    zero = np.zeros(1, np.int64)
    judge(zero, zero, np.einsum("nd,nd->n", a[:1], b[:1]))
    while todo:
        i, j = todo.pop()
        same = (i == j) if own else np.zeros(len(i), bool)
        for alone in (False, True):
            p, q = i[same == alone], j[same == alone]
            for c, d, cos in _products(open_a[p], many_a[p], open_b[q], many_b[q], lambda k: a[left.lo[k]], lambda k: b[right.lo[k]]):
                once = c <= d if alone else slice(None)  # a node's children among themselves
                judge(c[once], d[once], cos[once])
    return found


# --- over the tables ------------------------------------------------------------------------------------


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of numbers as unit vectors; scaled by the largest number first, so that squares neither overflow nor vanish."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("nd,nd->n", vectors, vectors))[:, None]


CELLS = ["label", "dims", "path"]


def _nearest(points: pa.Table, pivots: pa.Table) -> pa.Table:
    """The points with the number of the nearest pivot at the end of their path."""
    if not len(points) or not len(pivots):
        return points.select(["point", "path"])
    level = pivots["level"][0].as_py()
    some = _units(pivots["pivots"].combine_chunks().flatten())
    apart = _apart(some @ some.T) > 2.0 ** (1 - level)
    chosen: list[int] = []
    for k in range(len(some)):
        if apart[k, chosen].all() and len(chosen) < pivots["most"][0].as_py():
            chosen.append(k)
    near = (_units(points["vector"]) @ some[chosen].T).argmax(axis=1)
    path = [f"{p}.{k}" for p, k in zip(points["path"].to_pylist(), near.tolist(), strict=True)]
    return pa.table({"point": points["point"], "path": pa.array(path, pa.string())})


def _cells(points: DataFrame, cell: int) -> DataFrame:
    """`points` with the path of their cell: below the label's root, the pivots they are dealt to from level to level."""
    limit = F.least(F.lit(cell), F.greatest(F.lit(PIVOTS), F.floor(F.lit(COMPONENTS) / F.col("dims")))).cast("long")
    paths = points.select("point", F.lit("").alias("path"))
    for level in range(1, DIVISIONS + 1):
        placed = points.join(paths, "point")
        large = settled(
            placed.groupBy(*CELLS).agg(F.count("*").alias("size")).withColumn("limit", limit).filter("size > limit"), "cover-large"
        )
        if large.isEmpty():
            return placed
        inside = placed.join(large, CELLS)
        # About so many points of each cell, by a hash, whatever its size; those far enough apart become its pivots.
        share = F.lit(float(2**63)) * PIVOTS / F.col("size")
        sampled = inside.filter(F.abs(F.xxhash64("point", F.lit(level)).cast("double")) < share).groupBy(*CELLS).agg(
            F.sort_array(F.collect_list(F.struct("point", "vector")))["vector"].alias("pivots"),
            F.first("size").alias("size"), F.first("limit").alias("limit"),
        )
        chunks = F.ceil(F.col("size") / F.col("limit"))
        pivots = sampled.select(
            *(F.col(c).alias(f"{c}_") for c in CELLS), "pivots", F.lit(level).alias("level"),
            F.least(F.lit(PIVOTS), chunks * 2 + 1).cast("int").alias("most"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk_"),
        )
        dealt = inside.select(*CELLS, F.pmod(F.xxhash64("point"), chunks).alias("chunk"), "point", "vector")
        moved = dealt.groupBy(*CELLS, "chunk").cogroup(pivots.groupBy(*(f"{c}_" for c in CELLS), "chunk_")).applyInArrow(
            _nearest, "point long, path string"
        )
        kept = paths.join(moved.select("point", F.col("path").alias("deeper")), "point", "left")
        paths = settled(kept.select("point", F.coalesce("deeper", "path").alias("path")), "cover-paths")
    placed = points.join(paths, "point")
    sizes = placed.groupBy(*CELLS).agg(F.ceil(F.count("*") / F.first(limit)).alias("parts"))
    part = F.concat("path", F.lit(".h"), F.pmod(F.xxhash64("point"), "parts").cast("string"))
    return placed.join(sizes, CELLS).withColumn("path", F.when(F.col("parts") > 1, part).otherwise(F.col("path"))).drop("parts")


NODES = ("lo", "hi", "first", "last")
PARTS = ("points", "weights", "vectors", "radii", *NODES)  # of a tree, as columns of its row


def _tree(cell: pa.Table) -> pa.Table:
    """One row: the cell, its root's centre and radius, its nodes, and its points, weights and vectors in tree order."""
    points = _units(cell["vector"])
    tree = CoverTree.build(points)
    point, n, vector = (cell[c].combine_chunks().take(pa.array(tree.order)) for c in ("point", "n", "vector"))
    row = {c: pa.array([cell[c][0].as_py()], cell.schema.field(c).type) for c in CELLS}
    row["centre"] = pa.array([points[tree.order[0]]], pa.list_(pa.float64()))
    row["radius"] = pa.array(tree.radius[:1])
    whole = {"points": point, "weights": n, "vectors": vector.flatten(), "radii": pa.array(tree.radius)}
    whole |= {f: pa.array(getattr(tree, f), pa.int32()) for f in NODES}
    row |= {name: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for name, v in whole.items()}
    return pa.table(row)


def _read(batch: pa.RecordBatch, row: int, side: str) -> tuple[CoverTree, np.ndarray, np.ndarray, np.ndarray]:
    """Tree, unit vectors, weights and point numbers of one side of a row."""
    got = {name: batch.column(batch.schema.get_field_index(side + name))[row].values for name in PARTS}
    size = len(got["points"])
    vectors = _units(pa.FixedSizeListArray.from_arrays(got["vectors"], len(got["vectors"]) // size))
    arrays = {f: got[f].to_numpy().astype(np.int64) for f in NODES}
    tree = CoverTree(order=np.arange(size), radius=got["radii"].to_numpy(), **arrays)
    return tree, vectors, got["weights"].to_numpy(), got["points"].to_numpy()


def _walk(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """(a, b, links): the links of point a where b is null, else an edge."""
    for batch in batches:
        own = "right_points" not in batch.schema.names
        for row in range(len(batch)):
            left, a, wa, points = _read(batch, row, "left_")
            right, b, wb, others = (left, a, wa, points[:0]) if own else _read(batch, row, "right_")
            found = traverse(left, a, wa, right, b, wb, cosine, own)
            numbers = np.concatenate([points, others])
            linked = np.flatnonzero(found.total())
            i, j = found.forest()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([numbers[linked], numbers[i]])),
                    pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(numbers[j])]),
                    pa.concat_arrays([pa.array(found.total()[linked]), pa.nulls(len(i), pa.int64())]),
                ],
                ["a", "b", "links"],
            )


def _gap(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def _meeting(trees: DataFrame, cosine: float) -> DataFrame:
    """label, dims, a, b: the pairs of cells (a before b, or twice the same) that may hold a link.

    The cells of a label are walked against each other from the top: a pair of nodes is opened into
    the pairs of their children, and those whose bounds are too far apart are left out.
    """
    limit = math.sqrt(2 - 2 * cosine) + SLACK
    cells = trees.select(*CELLS, "centre", "radius", F.split("path", r"\.").alias("steps"))
    depth = cells.agg(F.max(F.size("steps"))).first()[0] or 1
    met = cells.select("label", "dims").distinct().select("label", "dims", F.lit("").alias("a"), F.lit("").alias("b"))
    for level in range(1, depth):
        prefix = [F.array_join(F.slice("steps", 1, n), ".") for n in (level, level + 1)]
        under = cells.select("label", "dims", prefix[0].alias("parent"), prefix[1].alias("node"), "path", "centre", "radius")
        middle = under.groupBy("label", "dims", "node").agg(F.min_by("centre", "path").alias("middle"))
        nodes = settled(
            under.join(middle, ["label", "dims", "node"]).groupBy("label", "dims", "parent", "node")
            .agg(F.first("middle").alias("middle"), F.max(_gap(F.col("middle"), F.col("centre")) + F.col("radius")).alias("reach")),
            "cover-nodes",
        )
        one = nodes.select("label", "dims", F.col("parent").alias("a"), F.col("node").alias("x"), F.col("middle").alias("mx"), F.col("reach").alias("rx"))
        two = nodes.select("label", "dims", F.col("parent").alias("b"), F.col("node").alias("y"), F.col("middle").alias("my"), F.col("reach").alias("ry"))
        opened = met.join(one, ["label", "dims", "a"]).join(two, ["label", "dims", "b"]).filter("a < b OR x <= y")
        close = (F.col("x") == F.col("y")) | (_gap(F.col("mx"), F.col("my")) <= limit + F.col("rx") + F.col("ry"))
        met = settled(opened.filter(close).select("label", "dims", F.col("x").alias("a"), F.col("y").alias("b")), "cover-pairs")
    return met


def links(points: DataFrame, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """(a, b, links) over `points` (point, label, dims, vector, n): how many vectors each is linked with, and a forest of the links."""
    kind = points.schema["vector"].dataType.elementType.simpleString()
    schema = (
        f"label {points.schema['label'].dataType.simpleString()}, dims int, path string, centre array<double>, radius double, "
        f"points array<long>, weights array<long>, vectors array<{kind}>, radii array<double>, "
        + ", ".join(f"{f} array<int>" for f in NODES)
    )
    trees = settled(
        _cells(points, cell).select(*CELLS, "point", "n", "vector").groupBy(*CELLS).applyInArrow(_tree, schema), "cover-trees"
    )
    out, walk = "a long, b long, links long", lambda batches: _walk(batches, cosine)
    side = {s: [F.col(c).alias(f"{s}_{c}") for c in PARTS] for s in ("left", "right")}
    found = trees.select(*side["left"]).mapInArrow(walk, out)
    others = _meeting(trees, cosine).filter("a <> b")
    left = trees.select("label", "dims", F.col("path").alias("a"), *side["left"])
    right = trees.select("label", "dims", F.col("path").alias("b"), *side["right"])
    both = others.join(left, ["label", "dims", "a"]).join(right, ["label", "dims", "b"])
    pairs = both.select(*(f"{s}_{c}" for s in ("left", "right") for c in PARTS)).mapInArrow(walk, out)
    return settled(found.union(pairs), "cover-links")


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, cell: int = CELL
) -> DataFrame:
    """key, n_links, component_id, kept for every row: links of at least `cosine` between vectors of one label.

    Vectors that are null or zero, or that hold null or non-finite numbers, link with nothing, nor
    do rows without label; vectors of different lengths do not either. Repeated rows and equal
    vectors are linked with each other. `component_id` is the least key that links lead to, null
    keys only if there is no other; such rows are kept like rows whose key is that least one. An
    empty table gives no rows; other columns are not read. Equal vectors travel as one with a
    weight; a label with most of the rows is divided into cells, and no pair of cells that may
    hold a link is left out.
    """
    column = dict(zip(vectors.columns, all_of(vectors), strict=True))
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    numbers = column[vector] if kind in ("float", "double") else column[vector].cast("array<double>")
    good = (
        (F.size(numbers) > 0) & column[label].isNotNull() & F.exists(numbers, lambda v: v != 0)
        & F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    )
    rows = vectors.select(column[key].alias("key"), column[label].alias("label"), F.when(good, numbers).alias("vector"))
    points = settled(
        rows.filter(F.col("vector").isNotNull()).groupBy("label", "vector").agg(F.min("key").alias("key"), F.count("*").alias("n"))
        .select("*", F.size("vector").alias("dims"), F.monotonically_increasing_id().alias("point")),
        "cover-points",
    )
    found = links(points, cosine, cell)
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("point")).agg(F.sum("links").alias("links"))
    member = components(found.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("point"), "component")
    rooted = points.join(member, "point", "left").join(counts, "point", "left").select(
        "label", "vector", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "point").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("key").alias("least"))
    told = rooted.join(least, "root").select("label", "vector", "n_links", "least")
    named = rows.join(told, ["label", "vector"], "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id"),
    )
    return named.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
