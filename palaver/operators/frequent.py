"""The most frequent texts by a small summary first: counts of a few candidates in place of all texts.

The first pass keeps, per task, counters of a bounded number of texts; when there are too many,
all are lowered alike and what was taken off is noted. Counters and notes of all tasks add up, and
give for every text a count it cannot exceed. The second pass counts the candidates exactly. If
the last of the top texts is above what any text left out can reach, the answer is proven; if not,
all texts are counted. Either way the rows are the exact ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.operators.transcripts import top_messages
from palaver.session import fresh_path

COUNTERS = 1 << 15  # that a task keeps
CANDIDATES = 8  # times as many as the answer has rows


def summarise(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """(mark, n): counters of marks, and one row without mark: by how much a count may be too low."""
    held: Counter = Counter()
    lowered = 0
    for batch in batches:
        found = pc.value_counts(batch.column(0))
        held.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)))
        if len(held) > 2 * counters:
            counts = np.fromiter(held.values(), np.int64, len(held))
            off = int(np.partition(counts, -counters - 1)[-counters - 1])
            lowered += off
            held = Counter({mark: n - off for mark, n in held.items() if n > off})
    yield pa.RecordBatch.from_arrays(
        [pa.array([*held, None], pa.int64()), pa.array([*held.values(), lowered], pa.int64())], ["mark", "n"]
    )


def frequent_messages(messages: DataFrame, n: int = 1000, counters: int = COUNTERS) -> tuple[DataFrame, bool]:
    """The n most frequent texts with counts, as `top_messages` gives them, and whether the summary proved them.

    Texts are summarised by a 64-bit mark, so a task holds numbers, whatever the length of the
    texts; candidates are counted by the text itself. Nulls do not count; of equal counts the lesser
    text is first, and a tie at the end that a text left out might join is not proven.
    """
    spark = messages.sparkSession
    marked = messages.where(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("mark"))
    path = fresh_path(spark, "frequent")
    marked.select("mark").mapInArrow(lambda batches: summarise(batches, counters), "mark long, n long").write.parquet(path)
    parts = spark.read.schema("mark long, n long").parquet(path)
    slack = parts.where(F.col("mark").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sums = parts.where(F.col("mark").isNotNull()).groupBy("mark").agg(F.sum("n").alias("n"))
    # One more than are kept: its count, and what may be missing from it, bounds all that is left out.
    most = CANDIDATES * n
    best = sums.orderBy(F.desc("n"), "mark").limit(most + 1).collect()
    left_out = (best[most]["n"] if len(best) > most else 0) + slack
    chosen = spark.createDataFrame([(row["mark"],) for row in best[:most]], "mark long")
    # At most `most` numbers: their size is known.
    counts = marked.join(F.broadcast(chosen), "mark", "left_semi").groupBy("text").agg(F.count("*").alias("messages"))
    exact = fresh_path(spark, "frequent")
    counts.orderBy(F.desc("messages"), "text").limit(n).write.parquet(exact)
    top = spark.read.schema("text string, messages long").parquet(exact)
    rows, last = top.agg(F.count("*"), F.min("messages")).first()
    proven = last > left_out if rows == n else left_out == 0
    return (top.orderBy(F.desc("messages"), "text") if proven else top_messages(messages, n)), proven
