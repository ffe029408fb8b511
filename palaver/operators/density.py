"""Gaussian kernel density of chat duration per sentiment."""

from __future__ import annotations

from math import ceil, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.schemas import SENTIMENTS

MOST_BINS = 1 << 20  # of one class
ERROR = 1e-6  # of a curve, as a share of the height of one row's kernel


def density(
    df: DataFrame,
    value: str = "DurationInMins",
    points: int = 500,
    cut: float = 0.0,
    closed: bool = False,
    round_to: int | None = None,
) -> DataFrame:
    """(Sentiment, i, x, density) on a grid over each class's own range.

    Bandwidth: sample deviation times n^(-1/5). The grid has `points` steps from the smallest to
    the largest value, without the last point, or with it if `closed`; `cut` widens the range by
    that many bandwidths on both sides. Classes with one row or no spread have no curve.

    Rows are first collapsed to (class, value, weight). Durations are whole seconds, so what
    meets the grid is bounded by the seconds a chat can last, however many chats there are;
    `round_to` places bound it for continuous values. The kernel sums combine on the map side.
    """
    number = F.col(value).cast("double")
    if round_to is not None:
        number = F.round(number, round_to)
    labels = F.array(*[F.lit(label) for label in SENTIMENTS])
    weighted = (
        df.where(F.col("Sentiment").isin(list(SENTIMENTS)))
        .select(F.array_position(labels, F.col("Sentiment")).cast("int").alias("c"), number.alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy("c", "v")
        .agg(F.count("*").alias("w"))
    )
    # At most one row per class on this side, so its broadcast is bounded.
    means = weighted.groupBy("c").agg(
        F.sum("w").alias("n"),
        (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
    )
    spread = F.sum(F.col("w") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean")))
    classes = (
        weighted.join(F.broadcast(means), "c")
        .groupBy("c", "n", "lo", "hi")
        .agg(spread.alias("ss"))
        .where((F.col("n") > 1) & (F.col("ss") > 0))
        .withColumn("h", F.sqrt(F.col("ss") / (F.col("n") - 1)) * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
        .withColumn("start", F.col("lo") - F.lit(cut) * F.col("h"))
        .withColumn("width", F.col("hi") - F.col("lo") + F.lit(2 * cut) * F.col("h"))
        .select("c", "n", "h", "start", "width")
    )
    # Few bytes that turn into many kernel values: dealt out by number, as by size it were one task.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = F.col("start") + F.col("i") * F.col("width") / F.lit(float(points - 1 if closed else points))
    z = (x - F.col("v")) / F.col("h")
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    sums = (
        weighted.repartition(tasks)
        .join(F.broadcast(classes), "c")
        .withColumn("i", grid)
        .groupBy("c", "i")
        .agg(F.sum(F.col("w") * F.exp(F.lit(-0.5) * z * z)).alias("s"))
    )
    return (
        sums.join(F.broadcast(classes), "c")
        .select(
            F.element_at(labels, F.col("c")).alias("Sentiment"),
            "i",
            x.alias("x"),
            (F.col("s") / (F.col("n") * F.col("h") * F.lit(sqrt(2 * pi)))).alias("density"),
        )
        .orderBy("Sentiment", "i")
    )


def error_of_bins(step: float, bandwidth: float) -> float:
    """By how much a curve of binned rows may differ from the exact one, at most.

    A row's weight goes to the two bins around it in proportion, so its kernel is read off a straight
    line between them: that differs by an eighth of the squared step times the kernel's greatest
    curvature.
    """
    return step**2 / (8 * bandwidth**3 * sqrt(2 * pi))


def _smoothed(bins: pd.DataFrame) -> pd.DataFrame:
    """The curve of one class from its bins: the weights convolved with the kernel by a fast Fourier transform."""
    first = bins.iloc[0]
    size, every, points = int(first["bins"]), int(first["every"]), int(first["points"])
    weights = np.zeros(size)
    weights[bins["bin"].to_numpy()] = bins["w"].to_numpy()
    z = np.arange(size) * first["step"] / first["h"]
    kernel = np.exp(-0.5 * z * z)
    # The kernel to both sides, around a circle wide enough that its ends do not meet.
    wide = 1 << (2 * size - 1).bit_length()
    ring = np.zeros(wide)
    ring[:size] = kernel
    ring[wide - size + 1 :] = kernel[:0:-1]
    sums = np.fft.irfft(np.fft.rfft(weights, wide) * np.fft.rfft(ring), wide)
    i = np.arange(points)
    density = np.maximum(sums[i * every], 0) / (first["n"] * first["h"] * sqrt(2 * pi))
    return pd.DataFrame({
        "Sentiment": first["label"], "i": i, "x": first["start"] + i * first["width"] / float(first["grid"]), "density": density,
        "error": error_of_bins(first["step"], first["h"]),
    })


def density_binned(
    df: DataFrame,
    value: str = "DurationInMins",
    points: int = 500,
    cut: float = 0.0,
    closed: bool = False,
    error: float = ERROR,
    most_bins: int = MOST_BINS,
) -> DataFrame:
    """(Sentiment, i, x, density, error): the curve of `density` for values of any kind, within a stated bound of it.

    Each class's range is cut into bins, as many for each step of the grid as the bound asks for,
    and a row is shared out to the two bins around it: one aggregate, whose result is as large as
    the bins, however many different values there are. The bins of a class are then smoothed in one
    step. `error` is what the curve may differ by, as a share of the height of a single row's kernel
    (1 / (bandwidth * sqrt(2 pi))); the column `error` states it in the curve's own unit. A class
    whose range is too wide for its bandwidth gets `most_bins` bins and states the larger bound.
    """
    grid = points - 1 if closed else points
    rows = df.where(F.col("Sentiment").isin(list(SENTIMENTS))).select(F.col("Sentiment").alias("label"), F.col(value).cast("double").alias("v"))
    rows = rows.where(F.col("v").isNotNull())
    spread = F.stddev_samp("v")
    found = rows.groupBy("label").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), spread.alias("s")).collect()
    kinds = "label string, n long, h double, start double, width double, step double, every int, bins int, grid int, points int"
    classes = []
    for c in found:  # one row per class
        if c["n"] > 1 and c["s"] and c["s"] > 0:
            h = c["s"] * c["n"] ** -0.2
            start, width = c["lo"] - cut * h, c["hi"] - c["lo"] + 2 * cut * h
            every = max(1, min(ceil(width / grid / (h * sqrt(8 * error))), most_bins // grid))
            bins = grid * every + 1
            classes.append((c["label"], c["n"], h, start, width, width / (bins - 1), every, bins, grid, points))
    if not classes:
        return df.sparkSession.createDataFrame([], "Sentiment string, i int, x double, density double, error double")
    about = df.sparkSession.createDataFrame(classes, kinds)
    place = (F.col("v") - F.col("start")) / F.col("step")
    low = F.least(F.greatest(F.floor(place), F.lit(0)), F.col("bins") - 2)
    share = place - low
    both = F.array(F.struct(low.alias("bin"), (1 - share).alias("w")), F.struct((low + 1).alias("bin"), share.alias("w")))
    binned = (
        rows.join(F.broadcast(about), "label")  # at most one row per class on this side
        .select("label", F.explode(both).alias("b")).select("label", "b.bin", "b.w")
        .groupBy("label", "bin").agg(F.sum("w").alias("w"))
    )
    curves = binned.join(F.broadcast(about), "label").groupBy("label").applyInPandas(
        _smoothed, "Sentiment string, i int, x double, density double, error double"
    )
    return curves.orderBy("Sentiment", "i")
