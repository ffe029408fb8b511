"""A serving table laid out along a space-filling curve, so that any mix of filters prunes row groups.

Sorting by time serves filters on time alone. Here every filtered column is cut into buckets that
hold about the same number of rows; the bits of the buckets, taken in turn from all columns, give
a place on a Morton curve, and rows are ranged and sorted by it. A row group then spans a small
range of every column, and the bounds in the footers leave out the groups a filter cannot meet.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.operators.filters import ChatFilter, within

COLUMNS = ("Date", "VIPLevel", "Brand", "CountryGroup1")
BITS = 6  # of a column's bucket
ACCURACY = 10_000  # of the quantiles, as Spark counts it: their ranks are right to one in so many
MOST_VALUES = 4096  # texts of a column that edges are taken from; of more, a share chosen by a hash
ROWS_PER_FILE = 1_000_000
ROW_GROUP_BYTES = 8 << 20
PAGE_ROWS = 20_000  # Parquet's own bound


def ordinal(column: Column, kind: T.DataType) -> Column:
    """A double in the order of the values: numbers as they are, times as seconds, dates as days."""
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_seconds(column.cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(column).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    return column.cast("double")


def text_edges(df: DataFrame, column: str, buckets: int, most: int = MOST_VALUES) -> list[str]:
    """Texts that cut a column into buckets of about the same number of rows, fewer if it has fewer values.

    They come from the values and their counts: of all, or, of a column with very many, of about
    `most` values that a hash picks.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    values = df.agg(F.approx_count_distinct(column)).first()[0]
    if values > most // 2:
        counts = counts.where(F.pmod(F.xxhash64("v"), F.lit(values)) < most // 2)
    rows = sorted((r["v"].encode(), r["v"], r["n"]) for r in counts.collect())
    total, passed, taken, edges = sum(n for _, _, n in rows), 0, 0, []
    for at, (_, value, n) in enumerate(rows):
        # The next edge is due where the rows passed so far fill another bucket; few values get an edge each.
        if at and (len(rows) <= buckets or passed * buckets >= (taken + 1) * total):
            edges.append(value)
            taken = passed * buckets // max(total, 1)
        passed += n
    return edges[: buckets - 1]


def bucket_of(column: Column, edges: Sequence[object]) -> Column:
    """How many of the sorted edges a value reaches, by halving: a few comparisons whatever their number."""
    if not edges:
        return F.lit(0)
    middle = len(edges) // 2
    above = bucket_of(column, edges[middle + 1 :])
    return F.when(column < F.lit(edges[middle]), bucket_of(column, edges[:middle])).otherwise(above + middle + 1)


def interleaved(buckets: Sequence[Column], bits: int) -> Column:
    """The bits of the buckets in turn, the highest ones first: a place on the Morton curve."""
    places = [
        F.shiftleft(F.shiftright(bucket, bit).bitwiseAND(F.lit(1)), bit * len(buckets) + n)
        for bit in range(bits)
        for n, bucket in enumerate(buckets)
    ]
    return reduce(Column.bitwiseOR, places)


def with_curve_place(df: DataFrame, columns: Sequence[str] = COLUMNS, bits: int = BITS, into: str = "_place") -> DataFrame:
    """Add each row's place on the curve over `columns`. A null counts as the lowest bucket.

    The edges of the buckets are quantiles, so a column's rows spread evenly over its bits; where
    few values repeat, each has a bucket of its own. They are read from these columns alone.
    """
    if len(columns) * bits > 62:
        raise ValueError("the bits of all columns must fit a long")
    named = {c: F.col(f"`{c}`") for c in columns}
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    numbers = {c: ordinal(named[c], df.schema[c].dataType) for c in columns if c not in texts}
    shares = [k / 2**bits for k in range(1, 2**bits)]
    edges = {c: text_edges(df.select(named[c].alias("v")), "v", 2**bits) for c in texts}
    if numbers:
        found = df.agg(*(F.percentile_approx(value, shares, ACCURACY).alias(f"edges_{n}") for n, value in enumerate(numbers.values()))).first()
        for n, (name, value) in enumerate(numbers.items()):
            edges[name] = sorted(set(found[n] or ()))
            named[name] = value
    buckets = []
    for name in columns:
        if edges[name]:
            # However few buckets there are, they spread over all bits.
            step = max(2**bits // (len(edges[name]) + 1), 1)
            at = F.coalesce(bucket_of(named[name], edges[name]), F.lit(0))
            buckets.append(F.least(F.when(named[name].isNull(), 0).otherwise(at * step), F.lit(2**bits - 1)).cast("long"))
    place = interleaved(buckets, bits) if buckets else F.lit(0).cast("long")
    return df.withColumn(into, place)


def second_of(moment: Column) -> Column:
    """A moment without zone as a whole number that grows with it. Readers compare bounds of numbers, but not of such moments."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), moment)


def _seconds(schema: T.StructType) -> dict[str, str]:
    return {f.name: f"{f.name}_second" for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)}


def write_clustered(
    facts: DataFrame,
    path: str,
    columns: Sequence[str] = COLUMNS,
    bits: int = BITS,
    rows_per_file: int = ROWS_PER_FILE,
    row_group_bytes: int = ROW_GROUP_BYTES,
    mode: str = "append",
) -> None:
    """Add rows to the table at `path`, laid out along the curve over `columns`.

    Every load is laid out by itself and leaves earlier files alone; their bounds prune alike. Spark
    does not hold a filter on a time without zone against the bounds of a row group, so the
    seconds of such columns are stored beside them. A
    place that holds very many rows is cut by a hash of the row's other columns, so no file is left
    with all of them. A page holds at most an eighth of a file's rows, as the bounds of pages prune too.
    """
    files = max(1, -(-facts.count() // rows_per_file))
    placed = with_curve_place(facts, columns, bits).withColumns({name: second_of(F.col(c)) for c, name in _seconds(facts.schema).items()})
    whole = [F.col(f"`{c}`") for c, kind in facts.dtypes if not kind.startswith("map")]
    (
        placed.withColumn("_cut", F.xxhash64(*whole))
        .repartitionByRange(files, "_place", "_cut").sortWithinPartitions("_place", "_cut").drop("_place", "_cut")
        .write.mode(mode).option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", min(PAGE_ROWS, max(1, rows_per_file // 8))).parquet(path)
    )


def read_clustered(spark: SparkSession, path: str, schema: T.StructType, chosen: ChatFilter | None = None) -> DataFrame:
    """The table, or the rows of it that a filter leaves.

    The filter's plain comparisons are checked against the bounds in the footers. Those on its date
    are doubled by bounds on the stored seconds, which follow from them.
    """
    seconds = _seconds(schema)
    stored = spark.read.schema(T.StructType([*schema.fields, *(T.StructField(n, T.LongType()) for n in seconds.values())])).parquet(path)
    if chosen is not None:
        stored = chosen.apply(stored)
        if "Date" in seconds:
            low, high = (None if b is None else second_of(F.lit(b).cast("timestamp_ntz")) for b in chosen.date)
            if high is not None and chosen.end_inclusive_day:
                high = high + 24 * 60 * 60
            for bound in within(seconds["Date"], low, high):
                stored = stored.where(bound)
    return stored.select(*[F.col(f"`{c}`") for c in schema.names])
