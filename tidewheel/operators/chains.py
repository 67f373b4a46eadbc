"""Time-series chains: windows linked to their mutual nearest neighbours to the right and left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.profile import ready
from tidewheel.runtime import cut
from tidewheel.settings import ZNORM


def all_chains(profile: DataFrame) -> DataFrame:
    """series_id, chain (its first window), pos, i, length, longest: every chain, single windows included.

    A window and its right neighbour are linked if each is the other's. Links form paths; pointer doubling finds each
    window's first and place in ceil(log2(length)) joins. ``longest`` marks the longest chain, the first of equals.
    """
    p = profile.select("series_id", "i", "left_j", "right_j")
    right = p.select("series_id", F.col("i").alias("from"), F.col("right_j").alias("i"))
    left = p.select("series_id", "i", F.col("left_j").alias("from"))
    links = right.join(left, ["series_id", "i", "from"])
    state = cut(p.select("series_id", "i").join(links, ["series_id", "i"], "left").select("series_id", "i", F.coalesce("from", "i").alias("up"), F.when(F.col("from").isNull(), 0).otherwise(1).cast("long").alias("pos")))
    while True:
        above = state.select("series_id", F.col("i").alias("up"), F.col("up").alias("next"), F.col("pos").alias("more"))
        state = cut(state.join(above, ["series_id", "up"]).select("series_id", "i", F.col("next").alias("up"), (F.col("pos") + F.col("more")).alias("pos"), (F.col("more") > 0).alias("moved")))
        if state.where("moved").isEmpty():
            break
        state = state.drop("moved")
    sizes = state.groupBy("series_id", F.col("up").alias("chain")).agg(F.count(F.lit(1)).alias("length"))
    best = sizes.groupBy("series_id").agg(F.min(F.struct((-F.col("length")).alias("n"), "chain"))["chain"].alias("best"))
    return (
        state.select("series_id", F.col("up").alias("chain"), "pos", "i")
        .join(sizes, ["series_id", "chain"])
        .join(best, "series_id")
        .select("series_id", "chain", "pos", "i", "length", (F.col("chain") == F.col("best")).alias("longest"))
    )


def anchored_chain(profile: DataFrame, anchor: int) -> DataFrame:
    """series_id, pos, i: the chain that starts at ``anchor`` and follows the links to the right."""
    chains = cut(all_chains(profile))
    own = chains.where(F.col("i") == anchor).select("series_id", "chain", F.col("pos").alias("start"))
    return chains.join(own, ["series_id", "chain"]).where(F.col("pos") >= F.col("start")).select("series_id", (F.col("pos") - F.col("start")).alias("pos"), "i")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def geometric_chains(profile: DataFrame, series: DataFrame, m: int, theta: float = 40.0) -> DataFrame:
    """series_id, chain (its last window), pos, i, score: backward chains that keep their direction, of three or more.

    From each window the left neighbours are followed as long as the angle, seen from the chain's last window, between
    a window and its left neighbour is at most ``theta`` degrees. ``score`` is the distance of both ends over the
    largest step: a higher one is a more gradual chain. One round of equi-joins extends all chains by one window.
    """
    z = ready(series, m, ZNORM).where("is_finite").select("series_id", "i", F.when(F.col("is_const"), F.transform("a", lambda x: F.lit(0.0))).otherwise(F.col("z")).alias("z"))
    z = cut(z)
    named = lambda i, name: z.select("series_id", F.col("i").alias(i), F.col("z").alias(name))
    links = cut(profile.where("left_j IS NOT NULL").select("series_id", F.col("i").alias("at"), F.col("left_j").alias("next")))
    first = links.select("series_id", F.col("at").alias("chain"), F.col("next").alias("at"))
    found = cut(first.select("series_id", "chain", F.lit(0).alias("pos"), F.col("chain").alias("i")).unionAll(first.select("series_id", "chain", F.lit(1), "at")))
    frontier, pos = cut(first), 1
    while True:
        pos += 1
        step = frontier.join(links, ["series_id", "at"]).join(named("chain", "zc"), ["series_id", "chain"]).join(named("at", "za"), ["series_id", "at"]).join(named("next", "zn"), ["series_id", "next"])
        x, y = _minus(F.col("za"), F.col("zc")), _minus(F.col("zn"), F.col("zc"))
        cosine = F.try_divide(_dot(x, y), F.sqrt(_dot(x, x) * _dot(y, y)))
        frontier = cut(step.where(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))) <= theta).select("series_id", "chain", F.col("next").alias("at")))
        if frontier.isEmpty():
            break
        found = cut(found.unionAll(frontier.select("series_id", "chain", F.lit(pos), "at")))
    long = found.groupBy("series_id", "chain").agg(F.max("pos").alias("last")).where("last >= 2")
    rows = found.join(long, ["series_id", "chain"]).join(named("i", "z"), ["series_id", "i"])
    before = rows.select("series_id", "chain", (F.col("pos") + 1).alias("pos"), F.col("z").alias("zb"))
    length = lambda a, b: F.sqrt(_dot(_minus(a, b), _minus(a, b)))
    steps = rows.join(before, ["series_id", "chain", "pos"]).groupBy("series_id", "chain").agg(F.max(length(F.col("z"), F.col("zb"))).alias("most"))
    ends = rows.where("pos = last").join(named("chain", "zc"), ["series_id", "chain"]).select("series_id", "chain", length(F.col("z"), F.col("zc")).alias("span"))
    score = steps.join(ends, ["series_id", "chain"]).select("series_id", "chain", F.try_divide("span", "most").alias("score"))
    return rows.join(score, ["series_id", "chain"]).select("series_id", "chain", "pos", "i", "score")
