"""Matrix profiles: the nearest neighbours of every window, by self-join or by joining two series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.distance import distance
from tidewheel.functions.windows import windows, z_norm
from tidewheel.plans import greedy, kernel, tiles
from tidewheel.runtime import ship
from tidewheel.settings import DEFAULT, ZNORM, Metric, Settings, check_arguments, check_window

Flags = DataFrame | Callable[[np.ndarray, int], np.ndarray] | None


def constant_flags(series: DataFrame, m: int, given: Flags) -> DataFrame | None:
    """(series_id, i, is_const): a table as it is, or what a function of (values, m) says of each whole series."""
    if given is None or isinstance(given, DataFrame):
        return given
    ship(series.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("idx").value.to_numpy(float)
        values[~np.isfinite(values)] = np.nan
        flags = np.asarray(given(values, m), bool) if len(values) >= m else np.zeros(0, bool)
        return pd.DataFrame({"series_id": pdf.series_id.iloc[0], "i": np.arange(len(flags)), "is_const": flags})

    return series.groupBy("series_id").applyInPandas(run, "series_id string, i long, is_const boolean")


def _blocks(block: int, m: int) -> int:
    """Windows of a block: no fewer than a window's points, which each block repeats."""
    return max(block, m)


def _width(series: DataFrame, plan: tiles.Plan) -> int:
    return tiles.width(plan.count, series.sparkSession.sparkContext.defaultParallelism)


def self_join(series: DataFrame, m: int, k: int = 1, metric: Metric = ZNORM, settings: Settings = DEFAULT, constant: Flags = None, strategy: str = "tiles", zone: int | None = None) -> DataFrame:
    """series_id, i, nn (the k nearest: d, j), left_d, left_j, right_d, right_j of each window.

    Windows with a missing value have no neighbours; among equal distances the smallest j wins. ``strategy``: ``tiles``
    (the numpy kernel), or ``sql`` (one theta join in Catalyst, for short series).
    """
    zone = settings.zone(m) if zone is None else zone
    check_arguments(m, k, metric)
    if strategy == "sql":
        return _sql_self_join(series, m, k, metric, zone)
    block = _blocks(settings.block, m)
    plan = tiles.self_plan(series, m, block)
    wide = _width(series, plan)
    rows = tiles.block_rows(series, m, wide * block, constant_flags(series, m, constant))
    return tiles.join(rows, rows, plan if wide == 1 else tiles.self_plan(series, m, wide * block), m, block, k, metric, zone, wide).drop("other_id")


def ab_join(a: DataFrame, b: DataFrame, m: int, k: int = 1, metric: Metric = ZNORM, settings: Settings = DEFAULT, constant_a: Flags = None, constant_b: Flags = None, pairs: DataFrame | None = None) -> DataFrame:
    """series_id, other_id, i, nn of each window of ``a`` against each series of ``b`` (or the ``pairs`` named)."""
    check_arguments(m, k, metric)
    block = _blocks(settings.block, m)
    plan = tiles.ab_plan(a, b, m, block, pairs)
    wide = _width(a, plan)
    left = tiles.block_rows(a, m, wide * block, constant_flags(a, m, constant_a))
    right = tiles.block_rows(b, m, wide * block, constant_flags(b, m, constant_b))
    return tiles.join(left, right, plan if wide == 1 else tiles.ab_plan(a, b, m, wide * block, pairs), m, block, k, metric, None, wide).select("series_id", "other_id", "i", "nn")


def ready(series: DataFrame, m: int, metric: Metric, constant: Flags = None) -> DataFrame:
    """Windows with the array that distances use. ``constant``: flags instead of the test for constant windows."""
    w = windows(series, m)
    flags = constant_flags(series, m, constant)
    if flags is not None:
        w = w.drop("is_const").join(flags.select("series_id", "i", F.col("is_const").alias("_flag")), ["series_id", "i"], "left")
        w = w.withColumn("is_const", F.col("is_finite") & F.coalesce("_flag", F.lit(False))).drop("_flag")
    return w.withColumn("z", F.when(F.col("is_finite"), z_norm(F.col("a"), F.col("mu"), F.col("sd"), 0.0 if metric.normalized else 1e-7))) if metric.normalized else w


def _sql_self_join(series: DataFrame, m: int, k: int, metric: Metric, zone: int) -> DataFrame:
    w = ready(series, m, metric)
    x = w.select(F.col("series_id"), F.struct(*w.columns).alias("x"))
    y = w.select(F.col("series_id"), F.struct(*w.columns).alias("y"))
    pairs = x.join(y, "series_id").where(F.abs(F.col("x.i") - F.col("y.i")) > zone).select("series_id", F.col("x.i").alias("i"), F.col("y.i").alias("j"), distance(metric, m).alias("d"))
    entry = F.when(F.col("d").isNotNull(), F.struct("d", "j"))
    side = lambda c: F.min(F.when(c & F.col("d").isNotNull(), F.struct("d", "j")))
    near = F.filter(F.array(F.min(entry)), lambda e: e.isNotNull()) if k == 1 else F.slice(F.array_sort(F.collect_list(entry)), 1, k)
    best = pairs.groupBy("series_id", "i").agg(near.alias("nn"), side(F.col("j") < F.col("i")).alias("l"), side(F.col("j") > F.col("i")).alias("r"))
    every = w.select("series_id", "i").join(best, ["series_id", "i"], "left")
    none = F.expr("CAST(array() AS array<struct<d:double,j:bigint>>)")
    return every.select("series_id", "i", F.coalesce("nn", none).alias("nn"), F.col("l.d").alias("left_d"), F.col("l.j").alias("left_j"), F.col("r.d").alias("right_d"), F.col("r.j").alias("right_j"))


def flat(profile: DataFrame) -> DataFrame:
    """One row per neighbour: rank from 1, d, j. Windows without neighbours have no rows."""
    keys = [c for c in ("series_id", "other_id", "i") if c in profile.columns]
    return profile.select(*keys, F.posexplode("nn").alias("rank", "n")).select(*keys, (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.d").alias("d"), F.col("n.j").alias("j"))


def nearest(profile: DataFrame) -> DataFrame:
    """The first neighbour as columns d and j (NULL where there is none)."""
    return profile.withColumns({"d": F.get("nn", F.lit(0))["d"], "j": F.get("nn", F.lit(0))["j"]})


def from_indices(profile: DataFrame, series: DataFrame, m: int, metric: Metric = ZNORM, other: DataFrame | None = None) -> DataFrame:
    """Distances rebuilt from (series_id, i, j): by two equi-joins with the windows. NULL where j is negative or missing."""
    x = ready(series, m, metric)
    y = x if other is None else ready(other, m, metric)
    left = profile.select("series_id", "i", "j").join(x.select("series_id", "i", F.struct(*x.columns).alias("x")), ["series_id", "i"])
    right = y.select("series_id", F.col("i").alias("j"), F.struct(*y.columns).alias("y")) if other is None else y.select(F.col("i").alias("j"), F.struct(*y.columns).alias("y"))
    return left.join(right, ["series_id", "j"] if other is None else ["j"], "left").select("series_id", "i", "j", distance(metric, m).alias("d"))


def distance_profile(series: DataFrame, query: list[float], metric: Metric = ZNORM, query_index: int | None = None, constant: Flags = None, query_constant: bool | None = None) -> DataFrame:
    """series_id, i, d: the distance of a query (driver-side, of window length) to every window of every series.

    A map over blocks of points with a halo: the query travels with the task, and a block's products with it are one sliding
    product (a Fourier transform for long queries), so there is no join and no window is ever an array of its own.
    ``query_index`` is the query's own place in the series, where the distance is exactly 0. A query with a missing value has
    no distances. ``constant`` and ``query_constant`` stand for the tests for constant windows.
    """
    m = len(query)
    check_window(m, m)
    q = np.asarray(query, float)
    block = _blocks(DEFAULT.block, m)
    rows = tiles.block_rows(series, m, block, constant_flags(series, m, constant))
    known = np.isfinite(q).all()
    ship(series.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kernel.prepare(q, m, metric, constant=None if query_constant is None else np.array([query_constant]))
        for batch in batches:
            for r in range(batch.num_rows):
                values, lo = tiles._array(batch.column(2), r), batch.column(1)[r].as_py() * block
                n = len(values) - m + 1
                d = kernel.distances_to(own, kernel.prepare(values, m, metric, lo, tiles._flags(batch.column(3), r, n))) if known else np.full(n, np.inf)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(batch.column(0)[r].as_py(), pa.string()), n), pa.array(lo + np.arange(n)), pa.array(d, mask=np.isinf(d))], names=["series_id", "i", "d"])

    out = rows.select(F.col("series_id").cast("string").alias("series_id"), "blk", "values", "const").mapInArrow(run, "series_id string, i long, d double")
    return out if query_index is None else out.withColumn("d", F.when((F.col("i") == query_index) & F.col("d").isNotNull(), 0.0).otherwise(F.col("d")))


def distance_matrix(a: DataFrame, b: DataFrame, m: int, metric: Metric = ZNORM) -> DataFrame:
    """series_id, i, other_id, j, d: all distances of the windows of ``a`` to those of ``b``. Quadratic by definition."""
    check_window(m, m)
    x, y = ready(a, m, metric), ready(b, m, metric)
    both = x.select("series_id", "i", F.struct(*x.columns).alias("x")).crossJoin(y.select(F.col("series_id").alias("other_id"), F.col("i").alias("j"), F.struct(*y.columns).alias("y")))
    return both.select("series_id", "i", "other_id", "j", distance(metric, m).alias("d"))


def discords(profile: DataFrame, m: int, k: int = 1, settings: Settings = DEFAULT) -> DataFrame:
    """The k windows with the farthest nearest neighbours, none in the zone of another: series_id, rank, i, d."""
    zone = settings.zone(m)
    # the k best lie among the best k * (2 * zone + 1) windows
    far = nearest(profile).where("d IS NOT NULL").select("series_id", "i", "d", (-F.col("d")).alias("key"))
    taken = greedy.least(greedy.apart(greedy.least(far, k * (2 * zone + 1)), zone), k)
    return taken.select("series_id", F.row_number().over(Window.partitionBy("series_id").orderBy("key", "i")).cast("int").alias("rank"), "i", "d")


def profile_in_memory(values: np.ndarray, m: int, metric: Metric = ZNORM, settings: Settings = DEFAULT, k: int = 1) -> kernel.Found:
    """The kernel on one array, for stateful operators."""
    return kernel.self_profile(values, m, metric, settings.zone(m), k)
