"""Pan matrix profiles: profiles over many window sizes, in an order that refines."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.approximate import anytime_profile
from tidewheel.operators.profile import nearest, self_join
from tidewheel.runtime import cut
from tidewheel.settings import DEFAULT, ZNORM, Metric, Settings, check_arguments, largest_window
from tidewheel.sources.series import numbered


def refining_order(n: int) -> list[int]:
    """0..n-1 by levels of the balanced tree whose root is the middle."""
    out, level = [], [(0, n)]
    while level:
        deeper = []
        for lo, hi in level:
            if lo < hi:
                mid = (lo + hi) // 2
                out.append(mid)
                deeper += [(lo, mid), (mid + 1, hi)]
        level = deeper
    return out


def window_sizes(n: int, low: int = 3, high: int | None = None, step: int = 1) -> list[int]:
    """Window sizes in refining order; bounds are kept within what the series allows."""
    most = largest_window(n)
    high = most if high is None else min(max(3, high), most)
    low = min(max(3, low), most)
    sizes = list(range(min(low, high), max(low, high) + 1, step))
    return [sizes[i] for i in refining_order(len(sizes))]


def pan_profile(series: DataFrame, low: int = 3, high: int | None = None, step: int = 1, updates: int | None = None, percentage: float = 1.0, metric: Metric = ZNORM, settings: Settings = DEFAULT, seed: int = 0, constant: Callable | None = None) -> DataFrame:
    """series_id, m, turn, i, d: the profile of each window size processed so far (``updates`` of them, all by default).

    One series. With ``percentage`` below 1 each profile is extended from every s-th window and refined by that share
    of the diagonals. ``constant``: a function of (values, m) instead of the test for constant windows.
    """
    check_arguments(max(3, low), 1, metric, percentage)
    n = series.agg((F.max("idx") + 1).alias("n")).first()["n"]
    out = None
    for turn, m in enumerate(window_sizes(n, low, high, step)[:updates]):
        p = self_join(series, m, metric=metric, settings=settings, constant=constant) if percentage >= 1 else anytime_profile(series, m, percentage, metric=metric, settings=settings, seed=seed, constant=constant)
        one = nearest(p).select("series_id", F.lit(m).alias("m"), F.lit(turn).alias("turn"), "i", "d")
        out = one if out is None else out.unionAll(one)
    return out


def pan_matrix(pan: DataFrame, sizes: list[int], n: int, threshold: float = 0.2, normalize: bool = True, contrast: bool = True, binary: bool = True, clip: bool = True, metric: Metric = ZNORM, spread: float | None = None) -> DataFrame:
    """series_id, m, i, value: the picture of a pan profile, every size from the smallest to the largest.

    Distances are scaled by the largest possible, replaced by their rank's logistic around ``threshold``, cut at it and
    clipped to 0..1, as asked. A size that wasn't processed shows the next larger one that was; positions without a
    distance get the largest value. ``spread`` is max - min of the series, for metrics of raw values.
    """
    if metric.normalized:
        scale = 2 * F.sqrt("m")
    else:
        scale = F.lit(abs(spread)) * F.pow("m", F.lit(1 / metric.p))
    cells = pan.select("series_id", "m", "i", "d")
    if normalize:
        cells = cells.withColumn("d", F.least(F.lit(1.0), F.col("d") / scale))
    if contrast:
        # a missing distance ranks last
        ranked = numbered(cells, ["series_id"], [F.col("d").asc_nulls_last(), F.col("m").asc(), F.col("i").asc()], "rank")
        total = cells.groupBy("series_id").agg(F.count(F.lit(1)).alias("total"))
        cells = ranked.join(total, "series_id").select("series_id", "m", "i", (1 / (1 + F.exp(-10 * (F.col("rank") / (F.col("total") - 1) - threshold)))).alias("d"))
    if binary:
        cells = cells.withColumn("d", F.when(F.col("d") <= threshold, 0.0).otherwise(1.0))
    if clip:
        cells = cells.withColumn("d", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("d"))))
    cells = cut(cells)
    done = sorted(r["m"] for r in cells.select("m").distinct().collect())  # window sizes: a driver-side parameter list
    shows = [(m, next((x for x in done if x >= m), None)) for m in sorted(sizes)]
    top = cells.groupBy("series_id").agg(F.max("d").alias("top"))
    grid = top.select("series_id", "top", F.explode(F.expr(f"sequence(0L, {n}L - 1)")).alias("i")).select("*", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(x).cast("int").alias("source")) for m, x in shows])).alias("x")).select("series_id", "top", "i", "x.m", "x.source")
    return grid.join(cells.select("series_id", F.col("m").alias("source"), "i", "d"), ["series_id", "source", "i"], "left").select("series_id", "m", "i", F.coalesce("d", "top").alias("value"))


def largest_distance(m: int, metric: Metric, spread: float) -> float:
    return 2 * math.sqrt(m) if metric.normalized else abs(spread) * m ** (1 / metric.p)


def contrast(d: np.ndarray, threshold: float) -> np.ndarray:
    """The contrast step on an array, for tests: logistic of the rank share."""
    flat = d.ravel()
    rank = np.empty(len(flat))
    rank[np.argsort(flat, kind="stable")] = np.arange(len(flat))
    return (1 / (1 + np.exp(-10 * (rank / (len(flat) - 1) - threshold)))).reshape(d.shape)
