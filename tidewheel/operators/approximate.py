"""Approximate profiles: sampled diagonals, and sampled rows extended along diagonals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.profile import Flags, constant_flags, ready
from tidewheel.functions.distance import distance
from tidewheel.plans import kernel, tiles
from tidewheel.runtime import cut, ship
from tidewheel.settings import DEFAULT, ZNORM, Metric, Settings, check_arguments


def chosen(diagonals: np.ndarray, percentage: float, updates: int, seed: int, start: int = 0) -> np.ndarray:
    """Whether each diagonal belongs to the ``updates`` from ``start`` on of ceil(1 / percentage) random, even parts."""
    parts = max(1, math.ceil(1 / percentage))
    x = diagonals.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    part = ((x ^ (x >> np.uint64(31))) % np.uint64(parts)).astype(np.int64)
    return (part >= start) & (part < start + updates)


class _Diagonals:
    """The nearest of each window of a tile over some diagonals; a diagonal costs time linear in its length.

    Like the rows of a tile, a diagonal only names candidates, which are measured: those that may be nearer than what a window
    has so far (for one neighbour; all pairs for more).
    """

    def __init__(self, a: kernel.Windows, b: kernel.Windows, of_a: kernel.Found, of_b: kernel.Found | None):
        self.a, self.b, self.rows = a, b, kernel.Rows(a, b, lambda r: (0, len(b)))
        self.one = of_a.near.d.shape[1] == 1
        self.best = np.full(len(a), -np.inf), np.full(len(b), -np.inf)  # less the bound
        both = of_b is not None
        self.pairs = [kernel.Candidates(a, b, (of_a.near, of_a.right) if both else (of_a.near,)), kernel.Candidates(a, b, (), (of_b.near, of_b.left) if both else ())]
        self.sides = 2 if both else 1

    def add(self, gap: int) -> None:
        """The pairs (i, i + gap) of global positions."""
        a, b = self.a, self.b
        first, last = max(a.lo, b.lo - gap), min(a.lo + len(a), b.lo + len(b) - gap)
        n = last - first
        if n <= 0:
            return
        i, j = first - a.lo, first + gap - b.lo
        sim, bound = self.rows.diagonal(i, j, n)
        for side, start in zip(range(self.sides), (i, j), strict=False):
            best = self.best[side][start : start + n]
            hit = np.flatnonzero((sim + bound >= best) & (sim > -np.inf) if self.one else sim > -np.inf)
            np.maximum(best, np.where(np.isfinite(bound), sim - bound, -np.inf), out=best)
            self.pairs[side].add(hit + i, hit + j)
            if self.pairs[side].size > kernel.Candidates.MANY:
                self.pairs[side].measure()

    def end(self) -> None:
        for p in self.pairs[: self.sides]:
            p.measure()


def _sample(m: int, block: int, wide: int, k: int, metric: Metric, zone: int | None, percentage: float, updates: int, seed: int, start: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                sid, oid, ia, ib = (batch.column(c)[r].as_py() for c in range(4))
                va, vb = tiles._array(batch.column(4), r), tiles._array(batch.column(6), r)
                a = kernel.prepare(va, m, metric, ia * wide * block, tiles._flags(batch.column(5), r, len(va) - m + 1))
                b = kernel.prepare(vb, m, metric, ib * wide * block, tiles._flags(batch.column(7), r, len(vb) - m + 1))
                gaps = np.arange(b.lo - (a.lo + len(a) - 1), b.lo + len(b) - a.lo)
                if zone is not None:
                    gaps = gaps[gaps > zone]
                of_a, of_b = kernel.Found.of(len(a), k), None if zone is None else kernel.Found.of(len(b), k)
                diagonals = _Diagonals(a, b, of_a, of_b)
                for gap in gaps[chosen(gaps, percentage, updates, seed, start)].tolist():
                    diagonals.add(gap)
                diagonals.end()
                yield tiles._emit(sid, oid, a.lo, of_a)
                if of_b is not None:
                    yield tiles._emit(sid, oid, b.lo, of_b)

    return run


def sampled_profile(series: DataFrame, m: int, percentage: float = 0.01, updates: int = 1, other: DataFrame | None = None, k: int = 1, metric: Metric = ZNORM, settings: Settings = DEFAULT, seed: int = 0, constant: Flags = None, other_constant: Flags = None, start: int = 0) -> DataFrame:
    """The profile over a random sample of diagonals: ``updates`` of ceil(1 / percentage) parts, from part ``start`` on.

    More updates with the same seed only add diagonals; all of them give the exact profile. Work is in proportion to the
    sample, whatever the windows' length; block rows hold several parts of long series, as those of a join do.
    """
    check_arguments(m, k, metric, percentage)
    zone = settings.zone(m) if other is None else None
    block = max(settings.block, m)
    spark = series.sparkSession
    planned = lambda size: tiles.self_plan(series, m, size) if other is None else tiles.ab_plan(series, other, m, size, None)
    plan = planned(block)
    wide = tiles.width(plan.count, spark.sparkContext.defaultParallelism)
    plan = plan if wide == 1 else planned(wide * block)
    left = tiles.block_rows(series, m, wide * block, constant_flags(series, m, constant))
    right = left if other is None else tiles.block_rows(other, m, wide * block, constant_flags(other, m, other_constant))
    ship(spark)
    rows = (
        plan.tiles.join(left.select("series_id", F.col("blk").alias("a"), F.col("values").alias("va"), F.col("const").alias("ca")), ["series_id", "a"])
        .join(right.select(F.col("series_id").alias("other_id"), F.col("blk").alias("b"), F.col("values").alias("vb"), F.col("const").alias("cb")), ["other_id", "b"])
        .select("series_id", "other_id", "a", "b", "va", "ca", "vb", "cb")
    )
    tasks = max(1, min(plan.count, 2 * spark.sparkContext.defaultParallelism + plan.count // 16))
    parts = rows.repartition(tasks).mapInArrow(_sample(m, block, wide, k, metric, zone, percentage, updates, seed, start), tiles.PROFILE)
    out = tiles.merge_profiles(parts, k)
    return out.drop("other_id") if other is None else out.select("series_id", "other_id", "i", "nn")


def updated_profile(profile: DataFrame, series: DataFrame, m: int, done: int, updates: int = 1, percentage: float = 0.01, other: DataFrame | None = None, k: int = 1, metric: Metric = ZNORM, settings: Settings = DEFAULT, seed: int = 0, constant: Flags = None, other_constant: Flags = None) -> DataFrame:
    """A sampled profile of the first ``done`` parts, carried on by the next ``updates``: only their diagonals are read.

    ``profile`` is what ``sampled_profile`` or this gave, stored by the caller; arguments have to be the same.
    """
    new = sampled_profile(series, m, percentage, updates, other, k, metric, settings, seed, constant, other_constant, done)
    if other is not None:
        return tiles.merge_profiles(profile.unionByName(new, allowMissingColumns=True).select("series_id", "other_id", "i", "nn", *(F.lit(None).cast(t).alias(c) for c, t in _SIDES)), k).select("series_id", "other_id", "i", "nn")
    both = profile.unionByName(new).withColumn("other_id", F.col("series_id"))
    return tiles.merge_profiles(both, k).drop("other_id")


_SIDES = (("left_d", "double"), ("left_j", "long"), ("right_d", "double"), ("right_j", "long"))


def _sampled_rows(m: int, block: int, metric: Metric, zone: int | None, s: int, k: int):
    """Whole profiles of every s-th window: offered to it and, in a self-join, to all windows it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                sid, oid, ia, ib = (batch.column(c)[r].as_py() for c in range(4))
                va, vb = tiles._array(batch.column(4), r), tiles._array(batch.column(6), r)
                a = kernel.prepare(va, m, metric, ia * block, tiles._flags(batch.column(5), r, len(va) - m + 1))
                same = zone is not None and ia == ib
                b = a if same else kernel.prepare(vb, m, metric, ib * block, tiles._flags(batch.column(7), r, len(vb) - m + 1))
                for x, y in ((a, b),) if same or zone is None else ((a, b), (b, a)):
                    at = np.flatnonzero((x.lo + np.arange(len(x))) % s == 0)
                    own, others = kernel.Found.of(len(x), k), kernel.Found.of(len(y), k)
                    for i in at.tolist():
                        j = np.arange(len(y))
                        d = kernel.exact(x, y, np.full(len(y), i), j)
                        if zone is not None:
                            d[np.abs(j + y.lo - (i + x.lo)) <= zone] = np.inf
                        best = np.argsort(np.round(d, kernel.DIGITS), kind="stable")[:k]
                        own.near.offer(slice(i, i + 1), d[best][None, :], np.where(np.isfinite(d[best]), best + y.lo, -1)[None, :])
                        if zone is not None:
                            others.near.offer(slice(0, len(y)), d[:, None], np.where(np.isfinite(d), i + x.lo, -1)[:, None])
                    yield tiles._emit(sid, oid, x.lo, own)
                    if zone is not None:
                        yield tiles._emit(sid, oid, y.lo, others)

    return run


def extended_profile(series: DataFrame, m: int, s: int | None = None, k: int = 1, metric: Metric = ZNORM, settings: Settings = DEFAULT, other: DataFrame | None = None, constant: Flags = None, other_constant: Flags = None) -> DataFrame:
    """series_id, i, nn: every s-th window's exact k nearest, the nearest carried s - 1 steps along its diagonal both ways.

    With ``other`` (one series each) the neighbours are its windows and there is no zone. The carried pairs are
    (i + g, j + g): an explode and two equi-joins with the windows.
    """
    check_arguments(m, k, metric)
    zone = settings.zone(m) if other is None else None
    s = max(1, settings.zone(m) if s is None else s)
    block = max(settings.block // 4, m)
    left = tiles.block_rows(series, m, block, constant_flags(series, m, constant))
    right = left if other is None else tiles.block_rows(other, m, block, constant_flags(other, m, other_constant))
    plan = tiles.self_plan(series, m, block) if other is None else tiles.ab_plan(series, other, m, block, None)
    spark = series.sparkSession
    ship(spark)
    rows = (
        plan.tiles.join(left.select("series_id", F.col("blk").alias("a"), F.col("values").alias("va"), F.col("const").alias("ca")), ["series_id", "a"])
        .join(right.select(F.col("series_id").alias("other_id"), F.col("blk").alias("b"), F.col("values").alias("vb"), F.col("const").alias("cb")), ["other_id", "b"])
        .select("series_id", "other_id", "a", "b", "va", "ca", "vb", "cb")
    )
    tasks = max(1, min(plan.count, 2 * spark.sparkContext.defaultParallelism + plan.count // 16))
    found = cut(tiles.merge_profiles(rows.repartition(tasks).mapInArrow(_sampled_rows(m, block, metric, zone, s, k), tiles.PROFILE), k)).select("series_id", "i", "nn")
    steps = [g for g in range(-(s - 1), s) if g]
    if not steps:
        return found
    seeds = found.where((F.col("i") % s == 0) & (F.size("nn") > 0)).select("series_id", "i", F.get("nn", F.lit(0))["j"].alias("j"))
    moved = seeds.select("series_id", "i", "j", F.explode(F.array(*map(F.lit, steps))).alias("g")).select("series_id", (F.col("i") + F.col("g")).alias("i"), (F.col("j") + F.col("g")).alias("j"))
    w = ready(series, m, metric, constant)
    v = w if other is None else ready(other, m, metric, other_constant)
    x = w.select("series_id", "i", F.struct(*w.columns).alias("x"))
    y = v.select(*(["series_id"] if other is None else []), F.col("i").alias("j"), F.struct(*v.columns).alias("y"))
    carried = moved.join(x, ["series_id", "i"]).join(y, ["series_id", "j"] if other is None else ["j"]).select("series_id", "i", "j", distance(metric, m).alias("d")).where("d IS NOT NULL")
    if other is not None:
        return _nearest_of(found, carried.select("series_id", "i", "d", "j"), k)
    both = carried.select("series_id", "i", "d", "j").unionAll(carried.select("series_id", F.col("j").alias("i"), "d", F.col("i").alias("j")))
    return _nearest_of(found, both, k)


def _nearest_of(profile: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each window, of its own and those that (series_id, i, d, j) offers."""
    own = profile.select("series_id", "i", F.explode("nn").alias("n")).select("series_id", "i", "n.d", "n.j")
    each = own.unionAll(pairs.select("series_id", "i", "d", "j")).groupBy("series_id", "i", "j").agg(F.min("d").alias("d"))
    entry = F.struct(F.round("d", kernel.DIGITS).alias("q"), "j", "d")
    best = F.array(F.min(entry)) if k == 1 else F.slice(F.array_sort(F.collect_list(entry)), 1, k)
    nn = each.groupBy("series_id", "i").agg(F.transform(best, lambda n: F.struct(n["d"].alias("d"), n["j"].alias("j"))).alias("nn"))
    none = F.expr("CAST(array() AS array<struct<d:double,j:bigint>>)")
    return profile.select("series_id", "i").join(nn, ["series_id", "i"], "left").select("series_id", "i", F.coalesce("nn", none).alias("nn"))


def anytime_profile(series: DataFrame, m: int, percentage: float = 0.01, updates: int = 1, s: int | None = None, k: int = 1, metric: Metric = ZNORM, settings: Settings = DEFAULT, seed: int = 0, other: DataFrame | None = None, constant: Flags = None, other_constant: Flags = None) -> DataFrame:
    """series_id, i, nn: the extended profile of every s-th window, refined by sampled diagonals."""
    sample = sampled_profile(series, m, percentage, updates, other, k, metric, settings, seed, constant, other_constant)
    pairs = sample.select("series_id", "i", F.explode("nn").alias("n")).select("series_id", "i", "n.d", "n.j")
    return _nearest_of(extended_profile(series, m, s, k, metric, settings, other, constant, other_constant), pairs, k)
