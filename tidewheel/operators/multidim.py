"""Multi-dimensional profiles, the subspace of a motif, and its description length.

Series are (series_id, dim, idx, value). For a pair of windows the distances of the dimensions are sorted (``include``
first, in the order given; ``discords`` sorts the rest descending) and the k-dimensional distance is the mean of the
first k. ``kdim`` counts from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.plans import kernel, tiles
from tidewheel.runtime import cut, ship
from tidewheel.settings import DEFAULT, ZNORM, Metric, Settings

STEP = 128


def _order(dims: int, include: Sequence[int] | None) -> list[int]:
    first = list(include or [])
    return first + [x for x in range(dims) if x not in first]


def k_means(d: np.ndarray, include: Sequence[int] | None, discords: bool) -> np.ndarray:
    """Distances (dims, ...) to k-dimensional distances (dims, ...)."""
    d = d[_order(len(d), include)]
    n = len(include or [])
    rest = np.sort(d[n:], axis=0)
    d = np.concatenate([d[:n], rest[::-1] if discords else rest])
    with np.errstate(invalid="ignore"):
        return np.cumsum(d, axis=0) / np.arange(1, len(d) + 1).reshape(-1, *[1] * (d.ndim - 1))


def _distances(a: kernel.Windows, b: kernel.Windows, rows: slice, cols: slice) -> np.ndarray:
    s = kernel.similarity(a, b, rows, cols)
    if a.metric.normalized:
        return np.where(s == -np.inf, np.inf, np.sqrt(np.maximum(0, 2 * a.m * (1 - s))))
    return np.where(s == -np.inf, np.inf, np.maximum(0, -s) ** (1 / a.metric.p))


def multi_tile(xs: list[kernel.Windows], ys: list[kernel.Windows], zone: int, include, discords: bool) -> tuple[list[kernel.Best], list[kernel.Best]]:
    """Best pair of each window and kdim for a tile of a self-join, for both sides."""
    dims = len(xs)
    a, b = xs[0], ys[0]
    of_a, of_b = [kernel.Best(len(a), 1) for _ in range(dims)], [kernel.Best(len(b), 1) for _ in range(dims)]

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return k_means(np.stack([kernel.exact(x, y, i, j) for x, y in zip(xs, ys, strict=True)]), include, discords)

    for r in range(0, len(a), STEP):
        rows = slice(r, min(len(a), r + STEP))
        for c in range(0, len(b), STEP):
            cols = slice(c, min(len(b), c + STEP))
            gap = (b.lo + np.arange(cols.start, cols.stop))[None, :] - (a.lo + np.arange(rows.start, rows.stop))[:, None]
            if gap.max() <= zone:
                continue
            means = k_means(np.stack([_distances(x, y, rows, cols) for x, y in zip(xs, ys, strict=True)]), include, discords)
            means[:, gap <= zone] = np.inf
            for k in range(dims):
                for best, d, flip in ((of_a[k], means[k], False), (of_b[k], means[k].T, True)):
                    low = d.min(axis=1)
                    there = np.isfinite(low)
                    real_of = (lambda i, j, k=k: exact(rows.start + j, cols.start + i)[k]) if flip else (lambda i, j, k=k: exact(rows.start + i, cols.start + j)[k])
                    # products lose small distances: whatever may be the nearest is measured directly
                    i, j = np.nonzero((d**2 <= np.where(there, low, 0)[:, None] ** 2 + 1e-9) & there[:, None])
                    real = real_of(i, j)
                    order = np.lexsort((j, np.round(real, kernel.DIGITS), i))
                    i, j, real = i[order], j[order], real[order]
                    first = np.unique(i, return_index=True)[1]
                    at, value = np.zeros(len(d), np.int64), np.full(len(d), np.inf)
                    at[i[first]], value[i[first]] = j[first], real[first]
                    real = value
                    lo = a.lo + rows.start if flip else b.lo + cols.start
                    best.offer(cols if flip else rows, np.where(there, real, np.inf)[:, None], np.where(there, lo + at, -1)[:, None])
    return of_a, of_b


def _as_dims(series: DataFrame) -> DataFrame:
    """Each dimension as a series of its own id, so that block rows can be made of it."""
    return series.select(F.concat_ws("\x1f", "series_id", F.col("dim").cast("string")).alias("series_id"), "idx", "value")


def multi_profile(series: DataFrame, m: int, include: Sequence[int] | None = None, discords: bool = False, metric: Metric = ZNORM, settings: Settings = DEFAULT, constant: DataFrame | None = None) -> DataFrame:
    """series_id, i, kdim, d, j: the self-join profile of every number of dimensions.

    ``constant``: (series_id, dim, i, is_const) instead of the test for constant windows.
    """
    ship(series.sparkSession)
    zone = settings.zone(m)
    block = max(settings.block // 4, m)
    flags = None if constant is None else constant.select(F.concat_ws("\x1f", "series_id", F.col("dim").cast("string")).alias("series_id"), "i", "is_const")
    of_dim = tiles.block_rows(_as_dims(series), m, block, flags)
    parts = F.split("series_id", "\x1f")
    rows = of_dim.select(parts[0].alias("series_id"), parts[1].cast("int").alias("dim"), "blk", "values", "const")
    rows = rows.groupBy("series_id", "blk").agg(F.sort_array(F.collect_list(F.struct("dim", "values", "const"))).alias("dims"))
    plan = tiles.self_plan(series.where("dim = 0"), m, block)
    pairs = (
        plan.tiles.drop("other_id")
        .join(rows.select("series_id", F.col("blk").alias("a"), F.col("dims").alias("x")), ["series_id", "a"])
        .join(rows.select("series_id", F.col("blk").alias("b"), F.col("dims").alias("y")), ["series_id", "b"])
        .select("series_id", "a", "b", "x", "y")
    )

    def of(dims: list[dict], lo: int) -> list[kernel.Windows]:
        out = []
        for d in dims:
            values = np.array([np.nan if v is None else v for v in d["values"]])
            flags = None if all(c is None for c in d["const"]) else np.array([bool(c) for c in d["const"][: len(values) - m + 1]])
            out.append(kernel.prepare(values, m, metric, lo, flags))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = of(row["x"], row["a"] * block)
                y = x if row["a"] == row["b"] else of(row["y"], row["b"] * block)
                for w, best in zip((x, y), multi_tile(x, y, zone, include, discords), strict=True):
                    for k, found in enumerate(best):
                        n = len(found.j)
                        gone = found.j[:, 0] < 0
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["series_id"]] * n), pa.array(w[0].lo + np.arange(n)), pa.array(np.full(n, k, np.int32)), pa.array(found.d[:, 0], mask=gone), pa.array(found.j[:, 0], mask=gone)],
                            names=["series_id", "i", "kdim", "d", "j"],
                        )

    tasks = max(1, min(plan.count, 2 * series.sparkSession.sparkContext.defaultParallelism + plan.count // 16))
    found = pairs.repartition(tasks).mapInArrow(run, "series_id string, i long, kdim int, d double, j long")
    best = F.min(F.when(F.col("j").isNotNull(), F.struct(F.round("d", kernel.DIGITS).alias("q"), "j", "d")))
    return found.groupBy("series_id", "i", "kdim").agg(best.alias("n")).select("series_id", "i", "kdim", F.col("n.d").alias("d"), F.col("n.j").alias("j"))


def window_dims(series: DataFrame, at: Sequence[int], m: int) -> dict[int, np.ndarray]:
    """(dims, m) values of the windows at some positions: a range scan of a few rows."""
    cond = F.lit(False)
    for i in at:
        cond = cond | F.col("idx").between(i, i + m - 1)
    rows = series.where(cond).select("dim", "idx", "value").collect()
    dims = 1 + max((r["dim"] for r in rows), default=-1)
    out = {i: np.full((dims, m), np.nan) for i in at}
    for r in rows:
        for i in set(at):
            if i <= r["idx"] < i + m:
                out[i][r["dim"], r["idx"] - i] = np.nan if r["value"] is None else r["value"]
    return out


def distance_profiles(series: DataFrame, m: int, query_index: int, include: Sequence[int] | None = None, discords: bool = False, metric: Metric = ZNORM) -> DataFrame:
    """series_id, i, kdim, d: one window against all, for every number of dimensions (no zone).

    The query's windows are literals, so each dimension is one map over its windows.
    """
    from tidewheel.operators.profile import distance_profile

    query = window_dims(series, [query_index], m)[query_index]
    each = None
    for n, q in enumerate(query):
        one = distance_profile(series.where(F.col("dim") == n).drop("dim"), q.tolist(), metric, query_index).withColumn("dim", F.lit(n))
        each = one if each is None else each.unionAll(one)
    return mean_of_best(each, ["series_id", "i"], len(query), include, discords)


def mean_of_best(each: DataFrame, keys: list[str], dims: int, include: Sequence[int] | None, discords: bool) -> DataFrame:
    """Rows (keys, dim, d) to (keys, kdim, d)."""
    first = list(include or [])
    rank = F.lit(len(first))
    for n, x in enumerate(first):
        rank = F.when(F.col("dim") == x, n).otherwise(rank)
    inf = F.coalesce("d", F.lit(float("inf")))
    value = F.when(rank < len(first), 0.0).otherwise(-inf if discords else inf)
    w = Window.partitionBy(*keys).orderBy(rank, value, "dim")
    ranked = each.select(*keys, (F.row_number().over(w) - 1).cast("int").alias("kdim"), F.avg("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("d"), F.count("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    return ranked.select(*keys, "kdim", F.when(F.col("n") == F.col("kdim") + 1, F.col("d")).alias("d"))


def _coded(windows: DataFrame, series: DataFrame, metric: Metric, bits: int, custom: Callable | None, m: int) -> DataFrame:
    """Rows (pair, dim, side, at, value) with ``code``: the value's step among 2 ** ``bits``.

    z-normalised windows get steps of equal probability under a normal distribution, raw ones even steps of the range of all
    values. ``custom`` is a function of an array of windows (z-normalised, or raw); it sees one pair's at a time.
    """
    if metric.normalized:
        of = Window.partitionBy("pair", "dim", "side")
        flat = F.max("value").over(of) == F.min("value").over(of)
        windows = windows.withColumn("value", F.when(flat, 0.0).otherwise((F.col("value") - F.avg("value").over(of)) / F.stddev_pop("value").over(of)))
        if custom is None:
            edges = F.array(*[F.lit(NormalDist().inv_cdf(q / 2**bits)) for q in range(1, 2**bits)])
            return windows.withColumn("code", F.size(F.filter(edges, lambda e: e < F.col("value"))).cast("double"))
    elif custom is None:
        span = series.agg(F.min("value").alias("_low"), F.max("value").alias("_high"))  # one row
        step = F.rint((F.col("value") - F.col("_low")) / (F.col("_high") - F.col("_low")) * (2**bits - 1)) + 1
        return windows.crossJoin(F.broadcast(span)).withColumn("code", step).drop("_low", "_high")
    ship(series.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "dim", "at"])
        return pdf.assign(code=np.asarray(custom(pdf.value.to_numpy(float).reshape(-1, m)), float).ravel())

    # a pair's windows: 2 x m values of each dimension
    return windows.groupBy("pair").applyInPandas(run, "pair int, dim int, side int, at long, value double, code double")


def motif_spaces(series: DataFrame, m: int, pairs: DataFrame, include: Sequence[int] | None = None, discords: bool = False, bits: int = 8, metric: Metric = ZNORM, discretize: Callable | None = None) -> DataFrame:
    """pair, place, dim, bits of each motif (pair, kdim, i, j): its kdim + 1 dimensions in order, and what encoding it costs.

    Dimensions are ordered by the distance of the discretised windows (``include`` first; ``discords`` the farthest first).
    The windows of the pairs are a join on ranges of positions; all else is an aggregate by pair and dimension.
    """
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("start")), F.struct(F.lit(1).alias("side"), F.col("j").alias("start"))))
    points = pairs.select("pair", "kdim", ends.alias("e")).select("pair", "kdim", "e.side", F.posexplode(F.sequence(F.col("e.start"), F.col("e.start") + (m - 1))).alias("at", "idx"))
    there = series.select("dim", F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))
    windows = there.join(points.withColumn("idx", F.col("idx").cast("long")), "idx")
    coded = _coded(windows.select("pair", F.col("dim").cast("int").alias("dim"), "side", F.col("at").cast("long").alias("at"), "value"), series, metric, bits, discretize, m)
    side = lambda n: F.max(F.when(F.col("side") == n, F.col("code")))
    steps = coded.groupBy("pair", "dim", "at").agg((side(0) - side(1)).alias("step"))
    p = float(metric.p or 2.0)
    far = steps.groupBy("pair", "dim").agg(F.pow(F.sum(F.pow(F.abs("step"), F.lit(p))), F.lit(1 / p)).alias("far"), F.collect_set("step").alias("steps"))
    first = list(include or [])
    given = F.array_position(F.array(*map(F.lit, first)), F.col("dim")) if first else F.lit(0)
    rank = F.when(given > 0, given - len(first) - 1).otherwise(0)
    order = [F.col("far").desc(), F.col("dim").desc()] if discords else [F.col("far"), F.col("dim")]
    ranked = far.withColumn("place", F.row_number().over(Window.partitionBy("pair").orderBy(rank, *order)) - 1)  # as many rows as dimensions
    total = F.count(F.lit(1)).over(Window.partitionBy("pair"))
    chosen = ranked.withColumn("dims", total).join(pairs.select("pair", "kdim"), "pair").where("place <= kdim")
    values = chosen.groupBy("pair").agg(F.size(F.array_distinct(F.flatten(F.collect_list("steps")))).alias("n"))
    size = F.col("kdim") + 1
    cost = bits * (2 * F.col("dims") * m - size * m) + size * m * F.log2(F.col("n").cast("double")) + F.col("n") * bits
    return chosen.join(values, "pair").select("pair", F.col("place").cast("int").alias("place"), "dim", cost.cast("double").alias("bits"))


def _pairs(series: DataFrame, rows: Sequence[tuple[int, int, int]]) -> DataFrame:
    """(pair, kdim, i, j) of motifs that the caller names: a row a dimension at most."""
    return series.sparkSession.createDataFrame([(n, int(k), int(i), int(j)) for n, (k, i, j) in enumerate(rows)], "pair int, kdim int, i long, j long")


def subspace(series: DataFrame, m: int, i: int, j: int, k: int, include: Sequence[int] | None = None, discords: bool = False, bits: int = 8, metric: Metric = ZNORM, discretize: Callable | None = None) -> DataFrame:
    """place, dim: the k + 1 dimensions of the motif (i, j), in order."""
    return motif_spaces(series, m, _pairs(series, [(k, i, j)]), include, discords, bits, metric, discretize).select("place", "dim")


def description_lengths(series: DataFrame, m: int, i: Sequence[int], j: Sequence[int], include: Sequence[int] | None = None, discords: bool = False, bits: int = 8, metric: Metric = ZNORM, discretize: Callable | None = None) -> DataFrame:
    """kdim, bits, subspace: what encoding each k-dimensional motif costs; the least is its natural size."""
    pairs = _pairs(series, [(k, a, b) for k, (a, b) in enumerate(zip(i, j, strict=True))])
    each = motif_spaces(series, m, pairs, include, discords, bits, metric, discretize)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "dim"))), lambda x: x["dim"])
    return each.groupBy(F.col("pair").alias("kdim"), "bits").agg(listed.alias("subspace"))


def multi_motifs(series: DataFrame, profile: DataFrame, m: int, min_neighbors: int = 1, max_distance: float | Callable | None = None, cutoffs: float | Sequence[float] | None = None, max_matches: int | None = 10, max_motifs: int = 1, k: int | None = None, include: Sequence[int] | None = None, metric: Metric = ZNORM, atol: float = 1e-8, settings: Settings = DEFAULT) -> DataFrame:
    """motif, rank, i, d, kdim, subspace, bits of one series. Without ``k`` the description length picks it."""
    from tidewheel.operators.search import match

    spark = series.sparkSession
    zone = settings.zone(m)
    p = cut(profile.where("d IS NOT NULL").select("kdim", "i", "d", "j"))
    if cutoffs is None:
        stats = p.groupBy("kdim").agg(F.greatest(F.avg("d") - 2 * F.stddev_pop("d"), F.min("d")).alias("c")).collect()
        bound = {r["kdim"]: r["c"] for r in stats}
    else:
        n = p.agg(F.max("kdim").alias("k")).first()["k"] or 0
        bound = {q: (cutoffs if isinstance(cutoffs, (int, float)) else cutoffs[q]) for q in range(n + 1)}
    found = []
    motif = 0
    while motif < max_motifs:
        best = {r["kdim"]: r["m"] for r in p.groupBy("kdim").agg(F.min(F.struct("d", "i", "j")).alias("m")).collect()}  # a row per dimension
        if len(best) < len(bound) or not best:
            break
        lengths = description_lengths(series, m, [best[q]["i"] for q in sorted(best)], [best[q]["j"] for q in sorted(best)], include, metric=metric).collect()
        size = k if k is not None else min(lengths, key=lambda r: (r["bits"], r["kdim"]))["kdim"]
        top = best[size]
        if top["d"] > bound[size] or top["j"] < 0 or (isinstance(max_distance, (int, float)) and top["d"] > max_distance):
            break
        dims = next(r["subspace"] for r in lengths if r["kdim"] == size)
        query = window_dims(series, [top["i"]], m)[top["i"]][dims]
        number = F.lit(None)
        for n, x in enumerate(dims):
            number = F.when(F.col("dim") == x, n).otherwise(number)
        part = series.where(F.col("dim").isin(dims)).withColumn("dim", number.cast("int"))
        rows = cut(match(part, query.tolist(), max_distance, max_matches, metric, top["i"], atol, settings))
        if rows.count() > min_neighbors:
            found.append(rows.select(F.lit(motif).alias("motif"), "rank", "i", "d", F.lit(size).alias("kdim"), F.array(*map(F.lit, dims)).alias("subspace"), F.lit(next(r["bits"] for r in lengths if r["kdim"] == size)).alias("bits")))
            motif += 1
        zones = rows.select(F.explode(F.sequence(F.col("i") - zone, F.col("i") + zone)).alias("i")).distinct()
        p = cut(p.join(zones, "i", "left_anti"))
    out = spark.createDataFrame([], "motif int, rank int, i long, d double, kdim int, subspace array<int>, bits double")
    for part in found:
        out = out.unionAll(part)
    return out


__all__ = ["description_lengths", "distance_profiles", "mean_of_best", "multi_motifs", "multi_profile", "subspace"]
