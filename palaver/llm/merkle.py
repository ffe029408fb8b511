"""A Merkle manifest of a table: one tree per group, and a tree over their roots.

Rows become leaves, numbered within their group in key order. On every level each node meets its
siblings by an equijoin on computed indices (exclusive-or for two slots, offsets within the run
otherwise), and the nodes in slot zero emit the parents. A level is written to the shared folder
with the siblings it found; walking the levels down again gives every leaf its path, so each level
is joined once up and once down and no task sees more than its share of any level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import all_of, settled
from palaver.operators.ordering import with_global_index

ARITY = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:binary,right:binary>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts put together, in lowercase hexadecimal digits."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """The hash of a row: every value as its length in bytes, a colon and itself; a dash for a null."""
    told = [v.cast("string") for v in values]
    return digest(*(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in told))


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """`nodes` with `left` and `right`: the hashes of the siblings before and after a node in its run, as text."""
    slot = F.col("i") % arity
    met, found = nodes, []
    for offset in range(1, arity):
        there = F.col("i").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("i") - slot + (slot + offset) % arity
        other = nodes.select("tree", F.col("i").alias("at"), F.col("hash").alias(f"hash_{offset}"))
        met = met.withColumn("at", there).join(other, ["tree", "at"], "left").drop("at")
        found.append(F.struct(((slot + offset) % arity).alias("slot"), F.col(f"hash_{offset}").alias("hash")))
    # After a sort by slot; a run that ends early has no rows, thus no hashes, in its last slots.
    run = F.array_sort(F.array(*found))

    def joined(side: Column) -> Column:
        return F.array_join(F.transform(F.filter(run, lambda s: side(s) & s.hash.isNotNull()), lambda s: s.hash), "")

    return met.select(
        *nodes.columns, joined(lambda s: s.slot < slot).alias("left"), joined(lambda s: s.slot > slot).alias("right")
    )


def grow(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees, and (tree, height, hash) of their roots.

    `nodes` holds the leaves: tree, i (from 0, without gaps), n (how many of the tree are on this
    level), hash, and whatever else the first level is to keep.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = [], [nodes.filter("n = 1").select("tree", F.lit(0).alias("height"), "hash")]
    while most > 1:
        level = settled(_siblings(nodes.filter("n > 1"), arity), "merkle-level")
        levels.append(level)
        nodes = level.filter(F.col("i") % arity == 0).select(
            "tree", F.expr(f"i div {arity}").alias("i"), F.ceil(F.col("n") / arity).alias("n"), digest("left", "hash", "right").alias("hash")
        )
        roots.append(nodes.filter("n = 1").select("tree", F.lit(len(levels)).alias("height"), "hash"))
        most = -(-most // arity)
    return levels, reduce(DataFrame.union, roots)


def descend(leaves: DataFrame, levels: list[DataFrame], roots: DataFrame, arity: int) -> DataFrame:
    """The leaves with their `path`: from the leaf up, the hashes left and right of the node in its run.

    `roots` gives tree, height and the path above each root.
    """
    ends = {row["height"] for row in roots.select("height").distinct().collect()}  # at most one per level
    below = None
    for height in range(len(levels), 0, -1):
        above = [] if below is None else [below.select("tree", F.col("i").alias("up"), "path")]
        if height in ends:
            above.append(roots.filter(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("up"), "path"))
        above = reduce(DataFrame.union, above)
        step = F.array(F.struct(F.unhex("left").alias("left"), F.unhex("right").alias("right")))
        level = levels[height - 1].withColumn("up", F.expr(f"i div {arity}"))
        rest = [c for c in level.columns if c not in ("left", "right", "up")]
        below = level.join(above, ["tree", "up"]).select(*rest, F.concat(step, F.col("path")).alias("path"))
    if below is not None and 0 not in ends:
        return below.select(*leaves.columns, "path")
    alone = leaves.filter("n = 1").join(roots.select("tree", "path"), "tree").select(*leaves.columns, "path")
    return alone if below is None else alone.union(below.select(*leaves.columns, "path"))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's hash gives along a path."""
    return F.aggregate(path, start, lambda h, s: digest(F.lower(F.hex(s.left)), h, F.lower(F.hex(s.right))))


def proof(path: Column) -> Column:
    """All hashes of a path, level by level from the leaf up, left to right, put together."""
    return F.array_join(F.transform(path, lambda s: F.concat(F.lower(F.hex(s.left)), F.lower(F.hex(s.right)))), "")


def manifest(
    docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, arity: int = ARITY, **more: Column
) -> DataFrame:
    """`key`, leaf, subroot, root, path and the columns `more` (expressions over `docs`) of every row.

    The leaves of a group stand in order of the key, null keys first; rows of one key in order of
    their hash, so repeated rows are leaves of their own and any order among them gives the same
    trees. The roots of the groups, null first and then by the bytes of the name, are the leaves of
    the last tree. A group of one row has its leaf as root. Blank and null values differ in their
    leaf; columns that are not named are not read. An empty table gives no rows. A group with most
    of the rows is numbered in ranges and joined by index, never in one task.
    """
    column = dict(zip(docs.columns, all_of(docs), strict=True))
    kept = {f"more_{k}": value for k, value in enumerate(more.values())}
    rows = settled(
        docs.select(
            column[group].alias("group"), column[key].alias("key"), leaf(*(column[f] for f in fields)).alias("hash"),
            F.monotonically_increasing_id().alias("row"), *(value.alias(name) for name, value in kept.items()),
        ),
        "merkle-rows",
    )
    numbered = with_global_index(rows, ["group", "key", "hash", "row"])
    groups = numbered.groupBy("group").agg(F.min("row_index").alias("first"), F.count("*").alias("n"))
    groups = settled(with_global_index(groups, ["group"]).withColumnRenamed("row_index", "tree"), "merkle-groups")
    of = groups.select(F.col("group").alias("of"), "first", "n", "tree")
    leaves = settled(
        numbered.join(of, F.col("group").eqNullSafe(F.col("of")))
        .select("tree", (F.col("row_index") - F.col("first")).alias("i"), "n", "hash", "key", *kept),
        "merkle-leaves",
    )
    levels, subroots = grow(leaves, arity)
    subroots = settled(subroots, "merkle-subroots")
    # The tree over the groups: their roots are its leaves, in order of the group.
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(groups.count()).alias("n"), "hash", "height")
    higher, root = grow(tops, arity)
    last = root.first()
    paths = descend(tops, higher, root.select("tree", "height", F.array().cast(PATH).alias("path")), arity)
    paths = settled(paths.select(F.col("i").alias("tree"), "height", "hash", "path"), "merkle-tops")
    names = [F.col(name).alias(told) for name, told in zip(kept, more, strict=True)]
    return (
        descend(leaves, levels, paths.select("tree", "height", "path"), arity)
        .join(paths.select("tree", F.col("hash").alias("subroot")), "tree")
        .select(F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", F.lit(last["hash"] if last else None).cast("string").alias("root"), "path", *names)
    )
