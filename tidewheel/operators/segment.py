"""Semantic segmentation: arcs between nearest neighbours that cross each position."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.windows import running_sum
from tidewheel.runtime import cut


def expected_arcs(w: int) -> np.ndarray:
    """Arcs expected over each of ``w`` positions if every link were random."""
    x = np.arange(w)
    return 2 * (x + 1) * (w - 1 - x) / w


def expected_arcs_one_sided(w: int) -> np.ndarray:
    """The same where links only go right."""
    h = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, w + 1))])
    x = np.arange(w)
    out = (w - 1 - x) * (h[w - 1] - h[np.maximum(w - 2 - x, 0)]) + (x + 1) / w
    out[-1] = 0
    return out


def corrected_arcs(links: np.ndarray, length: int, factor: int = 5, expected: np.ndarray | None = None, one_sided: bool = False) -> np.ndarray:
    """The corrected arc curve of an index array, or of each row of several, in memory (streams)."""
    w = links.shape[-1]
    i = np.arange(w)
    j = np.where(links < 0, i, links)
    own = np.arange(links.size // max(w, 1)).reshape(*links.shape[:-1], 1) * w  # where each row's steps begin
    count = lambda at: np.bincount((own + at).ravel(), minlength=links.size).reshape(links.shape)
    steps = count(np.minimum(i, j)) - count(np.maximum(i, j))
    ideal = expected if expected is not None else expected_arcs_one_sided(w) if one_sided else expected_arcs(w)
    cac = np.minimum(np.cumsum(steps, axis=-1) / np.where(np.asarray(ideal) == 0, 1e-10, ideal), 1.0)
    if factor > 0:
        cac[..., : length * factor] = 1.0
        cac[..., max(0, w - length * factor) :] = 1.0
    return cac


def arc_curve(links: DataFrame, length: int, factor: int = 5, expected: DataFrame | None = None) -> DataFrame:
    """series_id, i, arcs, cac from (series_id, i, j); a missing or negative j links a window to itself.

    Steps are summed block by block, with an offset of the blocks before. ``expected``: (series_id, i, iac) instead of the exact
    count expected under random links.
    """
    own = links.select("series_id", "i", F.when(F.col("j").isNull() | (F.col("j") < 0), F.col("i")).otherwise(F.col("j")).alias("j"))
    ends = own.select("series_id", F.explode(F.array(F.struct(F.least("i", "j").alias("i"), F.lit(1).alias("s")), F.struct(F.greatest("i", "j").alias("i"), F.lit(-1).alias("s")))).alias("e"))
    steps = ends.groupBy("series_id", F.col("e.i").alias("i")).agg(F.sum("e.s").alias("step"))
    n = own.groupBy("series_id").agg(F.count(F.lit(1)).alias("w"))
    stepped = own.select("series_id", "i").join(steps, ["series_id", "i"], "left").select("series_id", "i", F.coalesce("step", F.lit(0)).alias("step"))
    curve = running_sum(stepped, "step", "arcs").drop("step").join(n, "series_id")
    if expected is not None:
        curve = curve.join(expected, ["series_id", "i"], "left")
    else:
        curve = curve.withColumn("iac", 2.0 * (F.col("i") + 1) * (F.col("w") - 1 - F.col("i")) / F.col("w"))
    edge = (F.col("i") < length * factor) | (F.col("i") >= F.col("w") - length * factor) if factor > 0 else F.lit(False)
    cac = F.when(edge, 1.0).otherwise(F.least(F.col("arcs") / F.when(F.coalesce("iac", F.lit(0.0)) == 0, 1e-10).otherwise(F.col("iac")), F.lit(1.0)))
    return curve.select("series_id", "i", F.col("arcs").cast("long").alias("arcs"), cac.alias("cac"))


def regimes(curve: DataFrame, length: int, n_regimes: int, factor: int = 5) -> DataFrame:
    """series_id, regime (from 1), i: the positions where regimes change, one round (one row a series) each."""
    curve = cut(curve.select("series_id", "i", "cac"))
    out = None
    for n in range(1, n_regimes):
        best = cut(curve.groupBy("series_id").agg(F.min(F.struct("cac", "i")).alias("m")).select("series_id", F.lit(n).alias("regime"), F.col("m.i").alias("at")))
        out = best if out is None else out.unionAll(best)
        zone = length * factor
        curve = cut(curve.join(best.select("series_id", "at"), "series_id").select("series_id", "i", F.when((F.col("i") >= F.col("at") - zone) & (F.col("i") < F.col("at") + zone), 1.0).otherwise(F.col("cac")).alias("cac")))
    if out is None:
        return curve.where("false").select("series_id", F.lit(0).alias("regime"), "i")
    return out.select("series_id", "regime", F.col("at").alias("i"))
