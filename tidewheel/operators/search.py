"""Pattern search: matches of a query, and motifs of a series."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.profile import Flags, constant_flags, distance_profile, nearest
from tidewheel.plans import greedy
from tidewheel.runtime import cut
from tidewheel.settings import DEFAULT, ZNORM, Metric, Settings


def default_bound(d: np.ndarray) -> float:
    """The larger of mean - 2 standard deviations and the least, over finite distances."""
    d = d[np.isfinite(d)]
    return float(max(d.mean() - 2 * d.std(), d.min())) if len(d) else math.inf


def multi_profile(dims: DataFrame, query: Sequence[Sequence[float]], metric: Metric, query_index: int | None = None, constant: Flags = None) -> DataFrame:
    """The mean over dimensions of each dimension's distance profile; NULL where one has none."""
    total = None
    for n, q in enumerate(query):
        flags = constant.where(F.col("dim") == n).drop("dim") if isinstance(constant, DataFrame) else constant
        one = distance_profile(dims.where(F.col("dim") == n).drop("dim"), list(q), metric, query_index, flags)
        total = one if total is None else total.unionAll(one)
    return total.groupBy("series_id", "i").agg(F.when(F.count("d") == len(query), F.avg("d")).alias("d"))


def match(series: DataFrame, query: Sequence[float] | Sequence[Sequence[float]], max_distance: float | Callable[[np.ndarray], float] | None = None, max_matches: int | None = None, metric: Metric = ZNORM, query_index: int | None = None, atol: float = 1e-8, settings: Settings = DEFAULT, constant: Flags = None, query_constant: bool | None = None) -> DataFrame:
    """series_id, rank, i, d: windows near a query, none in the zone of a nearer one.

    ``query``: one list, or a list per dimension (then ``series`` has a column dim). ``max_distance``: a number, or a
    function of a series' distance profile; by default max(mean - 2 std, min). ``query_index`` is always the first.
    Only rows below the bound reach the greedy step, which goes by blocks of the series.
    """
    many = bool(query) and isinstance(query[0], (list, tuple, np.ndarray))
    m = len(query[0]) if many else len(query)
    zone = settings.zone(m)
    if not np.isfinite(np.asarray(query, float)).all():
        raise ValueError("a query to match must be finite")
    d = multi_profile(series, query, metric, query_index, constant) if many else distance_profile(series, list(query), metric, query_index, constant, query_constant)
    d = cut(d.where("d IS NOT NULL"))
    if callable(max_distance):
        # the caller's function sees a series' whole distance profile
        def bound_of(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"series_id": [pdf.series_id.iloc[0]], "bound": [float(max_distance(pdf.sort_values("i").d.to_numpy()))]})

        bound = d.groupBy("series_id").applyInPandas(bound_of, "series_id string, bound double")
    elif max_distance is None:
        bound = d.groupBy("series_id").agg(F.greatest(F.avg("d") - 2 * F.stddev_pop("d"), F.min("d")).alias("bound"))
    rows = d.withColumn("bound", F.lit(float(max_distance))) if isinstance(max_distance, (int, float)) else d.join(bound, "series_id")
    own = F.lit(False) if query_index is None else F.col("i") == query_index
    near = rows.where((F.col("d") <= F.col("bound") + atol) | own).withColumn("key", F.when(own, float("-inf")).otherwise(F.col("d")))
    taken = greedy.apart(near, zone)
    ranked = taken.withColumn("rank", F.row_number().over(Window.partitionBy("series_id").orderBy("key", "i")).cast("int"))
    return ranked.where(F.lit(True) if max_matches is None else F.col("rank") <= max_matches).select("series_id", "rank", "i", "d")


def window_at(series: DataFrame, i: int, m: int) -> list[float]:
    """One window's values (a range scan)."""
    rows = series.where(F.col("idx").between(i, i + m - 1)).orderBy("idx").select("value").collect()
    return [float("nan") if r["value"] is None else r["value"] for r in rows]


def motifs(series: DataFrame, profile: DataFrame, m: int, min_neighbors: int = 1, max_distance: float | Callable | None = None, cutoff: float | None = None, max_matches: int | None = 10, max_motifs: int = 1, metric: Metric = ZNORM, atol: float = 1e-8, exclude_all_matches: bool = False, settings: Settings = DEFAULT, constant: Flags = None) -> DataFrame:
    """motif, rank, i, d of one series: windows that recur, by the least profile value first.

    Each round is a distributed match of the best remaining window, whose matches stay a table; only the best window
    itself comes to the driver. ``exclude_all_matches`` blanks matches beyond ``max_matches`` too.
    """
    spark = series.sparkSession
    zone = settings.zone(m)
    flags = constant_flags(series, m, constant)
    flags = flags if flags is None or isinstance(constant, DataFrame) else cut(flags)
    p = cut(nearest(profile).where("d IS NOT NULL").select("i", "d"))
    if cutoff is None:
        s = p.agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.min("d").alias("least")).first()
        cutoff = max(s["mean"] - 2 * s["std"], s["least"]) if s["mean"] is not None else -1.0
    found: list[DataFrame] = []
    motif = 0
    while motif < max_motifs:
        best = p.agg(F.min(F.struct("d", "i")).alias("m")).first()["m"]
        if best is None or best["d"] > cutoff or (isinstance(max_distance, (int, float)) and best["d"] > max_distance):
            break
        i = best["i"]
        flag = None if flags is None else bool((flags.where(F.col("i") == i).first() or {"is_const": False})["is_const"])
        every = cut(match(series, window_at(series, i, m), max_distance, None if exclude_all_matches else max_matches, metric, i, atol, settings, flags, flag))
        kept = every if max_matches is None else every.where(F.col("rank") <= max_matches)
        if every.count() > min_neighbors:
            found.append(kept.select(F.lit(motif).alias("motif"), "rank", "i", "d"))
            motif += 1
        # matches stay a table: whatever their number, their zones are taken out by a join
        zones = every.select(F.explode(F.sequence(F.col("i") - zone, F.col("i") + zone)).alias("i")).union(spark.range(i, i + 1).toDF("i")).distinct()
        p = cut(p.join(zones, "i", "left_anti"))
    out = spark.createDataFrame([], "motif int, rank int, i long, d double")
    for part in found:
        out = out.unionAll(part)
    return out
