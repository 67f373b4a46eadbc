"""Sliding windows and their statistics as Spark window functions over blocks.

A series is dealt into blocks of ``BLOCK`` windows; the points that windows of a block need beyond its own are copied to
it from the next ones (its halo). Window functions then run block by block, so one long series is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Windows of a block; blocks are never shorter than a window.
BLOCK = 8192


def is_finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def halo(series: DataFrame, m: int, block: int | None = None) -> DataFrame:
    """Each point in the column blk's block and in those before it whose windows of ``m`` points reach it."""
    block = max(BLOCK if block is None else block, m)
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - (m + block - 2)) / block)).cast("long")
    last = F.floor(F.col("idx") / block).cast("long")
    return series.select("*", F.explode(F.sequence(first, last)).alias("blk"), last.alias("own"))


def frame(m: int, order: str = "idx", by: str = "series_id"):
    """The ``m`` points from a row on, within a block of ``halo``."""
    return Window.partitionBy(by, "blk").orderBy(order).rowsBetween(0, m - 1)


def own(rows: DataFrame, m: int) -> DataFrame:
    """Whole windows (column points counts theirs), each in its own block."""
    return rows.where((F.col("points") == m) & (F.col("blk") == F.col("own"))).drop("points", "blk", "own")


def _rolled(series: DataFrame, m: int, by: str, *more: Column) -> DataFrame:
    w = frame(m, by=by)
    safe = F.when(is_finite("value"), F.col("value"))
    stat = lambda c: F.when(F.col("is_finite"), F.col(c)).alias(c)
    each = halo(series, m).select(
        by, F.col("idx").alias("i"), "blk", "own", F.count(F.lit(1)).over(w).alias("points"), (F.count(safe).over(w) == m).alias("is_finite"),
        F.avg(safe).over(w).alias("mu"), F.stddev_pop(safe).over(w).alias("sd"), F.min(safe).over(w).alias("low"), F.max(safe).over(w).alias("high"), *more,
    )
    extra = [c for c in each.columns if c not in (by, "i", "blk", "own", "points", "is_finite", "mu", "sd", "low", "high")]
    return own(each, m).select(by, "i", *map(stat, ("mu", "sd", "low", "high")), "is_finite", (F.col("is_finite") & (F.col("low") == F.col("high"))).alias("is_const"), *extra)


def rolling(series: DataFrame, m: int, by: str = "series_id") -> DataFrame:
    """series_id, i, mu, sd (population), low, high, is_finite, is_const of each window of ``m`` points.

    Statistics of a window with a missing value are NULL.
    """
    return _rolled(series, m, by)


def windows(series: DataFrame, m: int, by: str = "series_id") -> DataFrame:
    """``rolling`` with the window's values in ``a`` (missing ones as 0)."""
    safe = F.when(is_finite("value"), F.col("value")).otherwise(0.0)
    return _rolled(series, m, by, F.collect_list(safe).over(frame(m, by=by)).alias("a"))


def z_norm(a: Column, mu: Column, sd: Column, threshold: float = 1e-7) -> Column:
    """A z-normalised array; a standard deviation of 0 or below the threshold counts as 1."""
    return F.transform(a, lambda x: (x - mu) / F.when((sd < threshold) | (sd == 0), 1.0).otherwise(sd))


def sliding_dot(series: DataFrame, query: list[float]) -> DataFrame:
    """series_id, i, qt: the dot product of a query with each window."""
    m = len(query)
    q = F.array(*[F.lit(float(x)) for x in query])
    value = F.when(is_finite("value"), F.col("value")).otherwise(float("nan"))
    each = halo(series, m).select("series_id", F.col("idx").alias("i"), "blk", "own", F.count(F.lit(1)).over(frame(m)).alias("points"), F.collect_list(value).over(frame(m)).alias("a"))
    return own(each, m).select("series_id", "i", F.aggregate(F.zip_with("a", q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("qt"))


def rolling_present(series: DataFrame, m: int) -> DataFrame:
    """series_id, i, mu, sd, low, high, n over the values that are there (n of them) in each window."""
    w = frame(m)
    safe = F.when(is_finite("value"), F.col("value"))
    out = halo(series, m).select(
        "series_id", F.col("idx").alias("i"), "blk", "own", F.avg(safe).over(w).alias("mu"), F.stddev_pop(safe).over(w).alias("sd"), F.min(safe).over(w).alias("low"), F.max(safe).over(w).alias("high"),
        F.count(safe).over(w).alias("n"), F.count(F.lit(1)).over(w).alias("points"),
    )
    return own(out, m)


def running_sum(rows: DataFrame, value: str, name: str, at: str = "i", block: int = BLOCK) -> DataFrame:
    """Rows (series_id, at, value) with the sum up to each row: block by block, and an offset of the blocks before."""
    dealt = rows.withColumn("blk", F.floor(F.col(at) / block).cast("long"))
    before = Window.partitionBy("series_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("series_id", "blk").agg(F.sum(value).alias("total")).select("series_id", "blk", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("series_id", "blk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn(name, F.sum(value).over(inside)).join(offsets, ["series_id", "blk"]).withColumn(name, F.col(name) + F.col("offset")).drop("blk", "offset")


def numbered_runs(rows: DataFrame, same: Column, name: str = "run") -> DataFrame:
    """Rows (series_id, i, ...) with the number of their run in a column: a row goes on with the run of the row at i - 1
    where that is there and ``same`` (over the aliases x, the row, and y, the one before) holds."""
    before = rows.select("series_id", (F.col("i") + 1).alias("i"), *[F.col(c) for c in rows.columns if c not in ("series_id", "i")])
    met = rows.alias("x").join(before.alias("y"), (F.col("x.series_id") == F.col("y.series_id")) & (F.col("x.i") == F.col("y.i")), "left")
    started = met.select("x.*", F.when(F.col("y.series_id").isNotNull() & same, 0).otherwise(1).alias("_new"))
    return running_sum(started, "_new", name).drop("_new")


def runs(rows: DataFrame, flag: str = "flag") -> DataFrame:
    """series_id, start, stop (exclusive): the stretches of (series_id, i, flag) where the flag holds."""
    kept = rows.where(flag).select("series_id", "i")
    return numbered_runs(kept, F.lit(True)).groupBy("series_id", "run").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop")).drop("run")


def zone_mask(rows: DataFrame, at: int, zone: int, value: str = "d") -> DataFrame:
    """Rows with ``value`` NULL in the exclusion zone around a position."""
    return rows.withColumn(value, F.when(F.abs(F.col("i") - at) > zone, F.col(value)))
