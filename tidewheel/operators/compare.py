"""Comparing series: MPdist, the consensus motif, and scores built on joins of two series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.windows import frame, halo, own, rolling
from tidewheel.operators.profile import Flags, ab_join, constant_flags, distance_profile, nearest, self_join
from tidewheel.plans import tiles
from tidewheel.runtime import cut
from tidewheel.settings import DEFAULT, ZNORM, Metric, Settings


#: Bins of a round, and values of a key that are ranked at last.
BINS, RANKED = 4096, 10_000


def _magnitude(v: Column) -> Column:
    """A number's sign and power of two, as a number of the same order."""
    power = F.floor(F.log2(F.abs(v))).cast("long") + 1100
    return F.when(v == 0, F.lit(0)).when(v > 0, power).otherwise(-power)


def kth_smallest(values: DataFrame, keys: list[str], at: DataFrame, value: str = "d") -> DataFrame:
    """keys and the value at the 0-based rank ``at`` (keys, at) among (keys, value); where it is missing, the largest there is.

    Rounds of counting narrow the range that holds the rank: by powers of two first, then in equal bins between the least and the
    largest value that is left, so that no outlier keeps values together. A number has 52 bits below its power and a round
    takes 12 of them: five rounds at most. Some thousand values of a key are ranked at last.
    """
    there = cut(values.where(f"{value} IS NOT NULL").select(*keys, value))
    span = there.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(F.lit(1)).alias("_n"))
    state = cut(span.join(at, keys).select(*keys, "_low", "_high", F.least(F.col("at"), F.col("_n") - 1).cast("long").alias("_rest"), "_n"))
    many, first = f"_n > {RANKED} AND _low < _high", True
    while not state.where(many).isEmpty():
        inside = there.join(state.where(many), keys).where(F.col(value).between(F.col("_low"), F.col("_high")))
        width = (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))
        bin_of = _magnitude(F.col(value)) if first else F.least(F.floor(width * BINS), F.lit(BINS - 1)).cast("long")
        counts = inside.groupBy(*keys, "_rest", bin_of.alias("_bin")).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        hit = placed.where("_before <= _rest AND _rest < _before + _n").select(*keys, "_low", "_high", (F.col("_rest") - F.col("_before")).alias("_rest"), "_n")
        state, first = cut(hit.unionByName(state.where(f"NOT ({many})"))), False
    left = there.join(state.where("_low < _high"), keys).where(F.col(value).between(F.col("_low"), F.col("_high")))
    ranked = left.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1).where("_r = _rest")
    return ranked.select(*keys, value).unionAll(state.where("_low = _high").select(*keys, F.col("_low").alias(value)))


def mpdist(a: DataFrame, b: DataFrame, m: int, percentage: float = 0.05, k: int | None = None, metric: Metric = ZNORM, pairs: DataFrame | None = None, settings: Settings = DEFAULT, constant_a: Flags = None, constant_b: Flags = None) -> DataFrame:
    """series_id, other_id, mpdist: the k-th smallest of both joins' profile values.

    k is min(ceil(percentage x points of both), values - 1), from 0. Where the k-th is missing, the largest finite value
    before it counts. By default every series of ``a`` is compared with every one of ``b``.
    """
    back = None if pairs is None else pairs.select(F.col("other_id").alias("series_id"), F.col("series_id").alias("other_id"))
    ab = nearest(ab_join(a, b, m, metric=metric, settings=settings, constant_a=constant_a, constant_b=constant_b, pairs=pairs)).select("series_id", "other_id", "d")
    ba = nearest(ab_join(b, a, m, metric=metric, settings=settings, constant_a=constant_b, constant_b=constant_a, pairs=back)).select(F.col("other_id").alias("series_id"), F.col("series_id").alias("other_id"), "d")
    both = cut(ab.unionAll(ba))
    sizes = both.groupBy("series_id", "other_id").agg(F.count(F.lit(1)).alias("n"))
    if k is None:
        points = lambda s, name: s.groupBy(F.col("series_id").alias(name)).agg((F.max("idx") + 1).alias(f"n_{name}"))
        sizes = sizes.join(points(a, "series_id"), "series_id").join(points(b, "other_id"), "other_id")
        at = F.least(F.ceil(F.lit(percentage) * (F.col("n_series_id") + F.col("n_other_id"))), F.col("n") - 1)
    else:
        at = F.least(F.lit(k), F.col("n") - 1)
    found = kth_smallest(both, ["series_id", "other_id"], sizes.select("series_id", "other_id", at.alias("at")))
    return sizes.select("series_id", "other_id").join(found, ["series_id", "other_id"], "left").withColumnRenamed("d", "mpdist")


def mpdist_matrix(series: DataFrame, m: int, percentage: float = 0.05, metric: Metric = ZNORM, settings: Settings = DEFAULT) -> DataFrame:
    """series_id, other_id, mpdist of every two series of a set, once each."""
    ids = cut(series.select("series_id").distinct())
    pairs = cut(ids.crossJoin(ids.select(F.col("series_id").alias("other_id"))).where("series_id < other_id"))
    return mpdist(series, series, m, percentage, metric=metric, pairs=pairs, settings=settings)


#: What a radius may exceed another by and still tie with it, and what rounding may add to that.
TIE_PART, TIE_MORE, SLACK = 1e-5, 1e-8, 1e-6


def _radius(series: DataFrame, own: str, i: int, m: int, metric: Metric, flags: DataFrame | None) -> float:
    """The largest of one window's nearest distances in the other series: a map over them."""
    at = series.where((F.col("series_id") == own) & F.col("idx").between(i, i + m - 1)).orderBy("idx").select("value")
    query = [float("nan") if r["value"] is None else r["value"] for r in at.collect()]  # one window
    flag = None
    if flags is not None:
        row = flags.where((F.col("series_id") == own) & (F.col("i") == i)).first()
        flag = bool(row and row["is_const"])
    each = distance_profile(series.where(F.col("series_id") != own), query, metric, constant=flags, query_constant=flag)
    return each.groupBy("series_id").agg(F.min("d").alias("d")).agg(F.max("d").alias("r")).first()["r"]


def consensus(series: DataFrame, m: int, metric: Metric = ZNORM, settings: Settings = DEFAULT, constant: Flags = None, few: int = 256, joined: list[int] | None = None) -> DataFrame:
    """series_id, i, radius, mean: the window that is nearest to all other series of the set, as a row.

    radius is the largest of its nearest-neighbour distances in the others; ties (up to 1e-5 of it) go to the smallest mean (its own
    series counting as 0), then to the first id and position.

    Every series is joined with the next one, then with two more, four more and so on. After each round the window that looks best
    so far is measured against all series; windows whose radius exceeds that one's already can't win and are dropped, and
    blocks without windows left are joined with nothing more. A set of ``few`` tiles is joined in one round. ``joined`` gets the
    number of tiles of each round.
    """
    numbered = cut(series.select("series_id").distinct().withColumn("n", F.row_number().over(Window.orderBy("series_id")) - 1))  # as many rows as series
    n = numbered.count()
    flags = constant_flags(series, m, constant)
    flags = flags if flags is None or isinstance(constant, DataFrame) else cut(flags)
    block = max(settings.block, m)
    total = tiles.lengths(series, m, block).agg(F.sum("blocks")).first()[0] or 0
    at_once = total * total <= few
    if not at_once:
        block = max(settings.block // 8, m)
    rows = tiles.block_rows(series, m, block, flags)
    rows = rows if at_once else cut(rows)
    live, least, done = None, None, 0
    while done < n - 1:
        more = range(1, n) if at_once else range(done + 1, min(n - 1, 2 * done + 1) + 1)
        ahead = numbered.select("series_id", F.explode(F.array(*[F.pmod(F.col("n") + o, F.lit(n)) for o in more])).alias("n"))
        pairs = ahead.join(numbered.select("n", F.col("series_id").alias("other_id")), "n").select("series_id", "other_id")
        plan = tiles.ab_plan(series, series, m, block, pairs)
        if live is not None:
            blocks = live.select("series_id", F.floor(F.col("i") / block).alias("a")).distinct()
            left = cut(plan.tiles.join(blocks, ["series_id", "a"], "left_semi"))
            plan = tiles.Plan(left, left.count(), plan.deep)
        if joined is not None:
            joined.append(plan.count)
        near = nearest(tiles.join(rows, rows, plan, m, block, 1, metric, None))
        each = near.groupBy("series_id", "i").agg(F.max("d").alias("radius"), F.sum("d").alias("total"), F.count("d").alias("there")).where(F.col("there") == len(more))
        if live is None:
            live = each.select("series_id", "i", "radius", "total")
        else:
            new = each.select("series_id", "i", F.col("radius").alias("_radius"), F.col("total").alias("_total"))
            live = live.join(new, ["series_id", "i"]).select("series_id", "i", F.greatest("radius", "_radius").alias("radius"), (F.col("total") + F.col("_total")).alias("total"))
        live, done = cut(live), more[-1]
        if done < n - 1:
            best = live.agg(F.min(F.struct("radius", "total", "series_id", "i")).alias("b")).first()["b"]
            if best is None:
                break
            radius = _radius(series, best["series_id"], best["i"], m, metric, flags)
            least = radius if least is None else min(least, radius)
            live = cut(live.where(F.col("radius") <= least * (1 + TIE_PART + SLACK) + TIE_MORE + SLACK))
    if live is None:  # one series has nothing to agree with
        return series.sparkSession.createDataFrame([(None, None, None, None)], "series_id string, i long, radius double, mean double")
    each = live.select("series_id", "i", "radius", (F.col("total") / n).alias("mean"))
    lowest = each.agg(F.min("radius").alias("r"))
    tied = each.join(F.broadcast(lowest), F.col("radius") <= F.col("r") + TIE_MORE + TIE_PART * F.col("r"))  # one row
    return tied.agg(F.min(F.struct("mean", "series_id", "i", "radius")).alias("b")).select("b.series_id", "b.i", "b.radius", "b.mean")


def shapelets(a: DataFrame, b: DataFrame, m: int, k: int = 10, metric: Metric = ZNORM, settings: Settings = DEFAULT) -> DataFrame:
    """series_id, i, diff: the k windows of ``a`` whose distance to ``b`` exceeds that within ``a`` most."""
    within = nearest(self_join(a, m, metric=metric, settings=settings)).select("series_id", "i", F.col("d").alias("own"))
    across = nearest(ab_join(a, b, m, metric=metric, settings=settings)).select("series_id", "i", "d")
    return across.join(within, ["series_id", "i"]).select("series_id", "i", (F.col("d") - F.col("own")).alias("diff")).where("diff IS NOT NULL").orderBy(F.col("diff").desc(), "series_id", "i").limit(k)


def swap_scores(heads: DataFrame, tails: DataFrame, m: int, epsilon: float = 1e-9, metric: Metric = ZNORM, settings: Settings = DEFAULT) -> DataFrame:
    """series_id, other_id, score: least distance of a head to another's tail over that to its own tail."""
    least = cut(nearest(ab_join(heads, tails, m, metric=metric, settings=settings)).groupBy("series_id", "other_id").agg(F.min("d").alias("d")))
    own = least.where("series_id = other_id").select("series_id", F.col("d").alias("own"))
    return least.where("series_id <> other_id").join(own, "series_id").select("series_id", "other_id", (F.col("d") / (F.col("own") + epsilon)).alias("score"))


def uniform_scaling(a: DataFrame, b: DataFrame, m: int, percents: list[int], metric: Metric = ZNORM, settings: Settings = DEFAULT) -> DataFrame:
    """series_id, other_id, i, scale, d, j: the best join of ``a`` with ``b`` resampled to each per cent of its length."""
    n = b.groupBy("series_id").agg((F.max("idx") + 1).alias("n"))
    scaled = b.join(n, "series_id").select("series_id", "idx", "value", "n")
    grid = n.select("series_id", "n", F.explode(F.array(*[F.lit(p) for p in percents])).alias("scale")).withColumn("idx", F.explode(F.expr("sequence(0L, ceil(n * scale / 100) - 1)")))
    taken = grid.withColumn("from", F.floor(F.col("idx") * 100 / F.col("scale")).cast("long"))
    stretched = taken.join(scaled.select("series_id", F.col("idx").alias("from"), "value"), ["series_id", "from"]).select(F.concat_ws("\x1f", "series_id", F.col("scale").cast("string")).alias("series_id"), "idx", "value")
    found = nearest(ab_join(a, stretched, m, metric=metric, settings=settings)).where("d IS NOT NULL")
    parts = F.split("other_id", "\x1f")
    each = found.select("series_id", parts[0].alias("other_id"), "i", F.struct("d", parts[1].cast("int").alias("scale"), "j").alias("b"))
    return each.groupBy("series_id", "other_id", "i").agg(F.min("b").alias("b")).select("series_id", "other_id", "i", "b.scale", "b.d", "b.j")


def annotate(profile: DataFrame, annotation: DataFrame) -> DataFrame:
    """series_id, i, d: the profile corrected by an annotation vector (series_id, i, av in 0..1): d + (1 - av) x max(d)."""
    top = profile.groupBy("series_id").agg(F.max("d").alias("top"))
    return profile.join(annotation, ["series_id", "i"]).join(top, "series_id").select("series_id", "i", (F.col("d") + (1 - F.col("av")) * F.col("top")).alias("d"))


def shapelet_features(series: DataFrame, shapelets: list[list[float]], metric: Metric = ZNORM) -> DataFrame:
    """series_id, shapelet, d: each series' least distance to each shapelet, as features for a classifier."""
    out = None
    for n, q in enumerate(shapelets):
        one = distance_profile(series, q, metric).groupBy("series_id").agg(F.min("d").alias("d")).select("series_id", F.lit(n).alias("shapelet"), "d")
        out = one if out is None else out.unionAll(one)
    return out


def steadiness(series: DataFrame, m: int, limit: float) -> DataFrame:
    """series_id, i, av: 1 where a window's sample variance is below ``limit``, else 0."""
    w = rolling(series, m)
    return w.select("series_id", "i", F.when(F.col("sd") * F.col("sd") * m / (m - 1) < limit, 1.0).otherwise(0.0).alias("av"))


def unclipped(series: DataFrame, m: int) -> DataFrame:
    """series_id, i, av: less for windows with more points at the series' least or largest value."""
    ends = series.groupBy("series_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    hit = series.join(ends, "series_id").select("series_id", "idx", ((F.col("value") == F.col("low")).cast("int") + (F.col("value") == F.col("high")).cast("int")).alias("hit"))
    w = frame(m)
    counts = own(halo(hit, m).select("series_id", F.col("idx").alias("i"), "blk", "own", F.sum("hit").over(w).alias("c"), F.count("hit").over(w).alias("points")), m)
    span = counts.groupBy("series_id").agg(F.min("c").alias("least"), F.max("c").alias("most"))
    return counts.join(span, "series_id").select("series_id", "i", (1 - F.coalesce(F.try_divide(F.col("c") - F.col("least"), F.col("most")), F.lit(0.0))).alias("av"))


def complexity(series: DataFrame, m: int) -> DataFrame:
    """series_id, i, av: each window's complexity estimate, scaled to 0..1 in its series."""
    order = Window.partitionBy("series_id", "blk").orderBy("idx")
    step = halo(series, m).withColumn("s", F.pow(F.lead("value").over(order) - F.col("value"), F.lit(2.0)))
    each = step.select("series_id", F.col("idx").alias("i"), "blk", "own", F.sum("s").over(order.rowsBetween(0, m - 2)).alias("s"), F.count("s").over(order.rowsBetween(0, m - 2)).alias("n"), F.count(F.lit(1)).over(frame(m)).alias("points"))
    ce = own(each, m).where(F.col("n") == m - 1).select("series_id", "i", F.sqrt("s").alias("ce"))
    span = ce.groupBy("series_id").agg(F.min("ce").alias("low"), F.max("ce").alias("high"))
    return ce.join(span, "series_id").select("series_id", "i", F.coalesce(F.try_divide(F.col("ce") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)).alias("av"))


def rank_position(percentage: float, points: int, values: int) -> int:
    return min(math.ceil(percentage * points), values - 1)
