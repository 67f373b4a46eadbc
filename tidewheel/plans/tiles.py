"""The tiled join: series as blocks of windows, pairs of blocks as rows, numpy kernel calls on pairs of their parts.

A block row holds the points of ``wide`` parts of ``block`` windows each, so a task needs two rows' points, whatever the
series' length. A row of work is a pair of block rows and stands for ``wide`` x ``wide`` kernel calls: long series get
wider rows, so that their points are copied once for each of ``wide`` parts of the other side instead of once a call.
Tiles are dealt round-robin: each is the same amount of work. A task merges what its tiles say about a part before it
emits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.plans import kernel
from tidewheel.runtime import ship
from tidewheel.settings import Metric

PROFILE = "series_id string, other_id string, i long, nn array<struct<d:double,j:long>>, left_d double, left_j long, right_d double, right_j long"
#: Parts whose results a task holds before it emits them.
HELD = 64
#: Parts of a block row at most, and rows of work that each core should have before rows get wider.
WIDE, ROWS = 8, 8


def width(tiles: int, cores: int) -> int:
    """Parts of a block row for a join of this many pairs of parts."""
    return max(1, min(WIDE, int((tiles / (ROWS * cores)) ** 0.5)))


def block_rows(series: DataFrame, m: int, block: int, flags: DataFrame | None = None) -> DataFrame:
    """series_id, blk, values, const: the points of each block of windows, and flags of its windows (null if not given)."""
    points = series.select("series_id", "idx", F.col("value").cast("double").alias("value"))
    if flags is not None:
        points = points.join(flags.select("series_id", F.col("i").alias("idx"), "is_const"), ["series_id", "idx"], "left")
    else:
        points = points.withColumn("is_const", F.lit(None).cast("boolean"))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - (m + block - 2)) / block)).cast("long")
    last = F.floor(F.col("idx") / block).cast("long")
    rows = points.select("series_id", F.explode(F.sequence(first, last)).alias("blk"), F.struct("idx", "value", "is_const").alias("p"))
    grouped = rows.groupBy("series_id", "blk").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return grouped.where(F.size("p") >= m).select("series_id", "blk", F.transform("p", lambda x: x["value"]).alias("values"), F.transform("p", lambda x: x["is_const"]).alias("const"))


def lengths(series: DataFrame, m: int, block: int) -> DataFrame:
    """series_id, blocks."""
    n = series.groupBy("series_id").agg((F.max("idx") + 1).alias("n")).where(F.col("n") >= m)
    return n.select("series_id", F.ceil((F.col("n") - m + 1) / block).cast("int").alias("blocks"))


@dataclass(frozen=True)
class Plan:
    tiles: DataFrame
    count: int
    deep: int  # most tiles that speak of one window


def self_plan(series: DataFrame, m: int, block: int) -> Plan:
    sizes = lengths(series, m, block)
    tiles = sizes.select("series_id", F.col("series_id").alias("other_id"), F.explode(F.sequence(F.lit(0).cast("long"), (F.col("blocks") - 1).cast("long"))).alias("a"), "blocks").select(
        "series_id", "other_id", "a", F.explode(F.sequence(F.col("a"), (F.col("blocks") - 1).cast("long"))).alias("b")
    )
    total = sizes.agg(F.sum(F.col("blocks").cast("long") * (F.col("blocks") + 1) / 2).alias("n"), F.max("blocks").alias("deep")).first()
    return Plan(tiles, int(total["n"] or 0), int(total["deep"] or 0))


def ab_plan(a: DataFrame, b: DataFrame, m: int, block: int, pairs: DataFrame | None) -> Plan:
    """``pairs``: (series_id, other_id) to join; all pairs of series by default."""
    of_a, of_b = lengths(a, m, block), lengths(b, m, block).select(F.col("series_id").alias("other_id"), F.col("blocks").alias("others"))
    both = of_a.join(pairs, "series_id").join(of_b, "other_id") if pairs is not None else of_a.crossJoin(of_b)
    tiles = both.select("series_id", "other_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("blocks") - 1).cast("long"))).alias("a"), "others").select(
        "series_id", "other_id", "a", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("others") - 1).cast("long"))).alias("b")
    )
    total = both.agg(F.sum(F.col("blocks").cast("long") * F.col("others")).alias("n"), F.max("others").alias("deep")).first()
    return Plan(tiles, int(total["n"] or 0), int(total["deep"] or 0))


def _array(column: pa.Array, row: int) -> np.ndarray:
    values = column[row].values
    return values.to_numpy(zero_copy_only=False).astype(np.float64)


def _flags(column: pa.Array, row: int, n: int) -> np.ndarray | None:
    values = column[row].values
    if values.null_count == len(values):
        return None
    return values.fill_null(False).to_numpy(zero_copy_only=False)[:n].astype(bool)


def _emit(sid: str, oid: str, lo: int, found: kernel.Found) -> pa.RecordBatch:
    n, k = found.near.d.shape
    there = found.near.j >= 0
    ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
    nn = pa.StructArray.from_arrays([pa.array(found.near.d[there]), pa.array(found.near.j[there])], names=["d", "j"])
    one = lambda b: (pa.array(b.d[:, 0], mask=b.j[:, 0] < 0), pa.array(b.j[:, 0], mask=b.j[:, 0] < 0))
    name = lambda x: pa.repeat(pa.scalar(x, pa.string()), n)
    return pa.RecordBatch.from_arrays(
        [name(sid), name(oid), pa.array(lo + np.arange(n)), pa.ListArray.from_arrays(pa.array(ends), nn), *one(found.left), *one(found.right)],
        names=["series_id", "other_id", "i", "nn", "left_d", "left_j", "right_d", "right_j"],
    )


def _parts(values: np.ndarray, flags: np.ndarray | None, m: int, metric: Metric, block: int, lo: int) -> list[kernel.Windows]:
    """The windows of a block row, part by part."""
    out = []
    for at in range(0, len(values) - m + 1, block):
        own = None if flags is None else flags[at : at + block]
        out.append(kernel.prepare(values[at : at + block + m - 1], m, metric, lo + at, own))
    return out


def _run(m: int, block: int, wide: int, k: int, metric: Metric, zone: int | None):
    """Rows (series_id, other_id, a, b, va, ca, vb, cb) to partial profiles. ``zone`` None: a join of two series."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, kernel.Found]] = {}

        def merge(key: tuple, lo: int, found: kernel.Found) -> None:
            if key in held:
                for name in ("near", "left", "right"):
                    other = getattr(found, name)
                    getattr(held[key][1], name).offer(slice(0, len(other.d)), other.d, other.j)
            else:
                held[key] = lo, found

        for batch in batches:
            for r in range(batch.num_rows):
                sid, oid, a, b = (batch.column(c)[r].as_py() for c in range(4))
                va, vb = _array(batch.column(4), r), _array(batch.column(6), r)
                xs = _parts(va, _flags(batch.column(5), r, len(va) - m + 1), m, metric, block, a * wide * block)
                same = zone is not None and a == b
                ys = xs if same else _parts(vb, _flags(batch.column(7), r, len(vb) - m + 1), m, metric, block, b * wide * block)
                for p, x in enumerate(xs):
                    for y in ys[p:] if same else ys:
                        if zone is None:
                            merge((sid, oid, x.lo), x.lo, kernel.ab_tile(x, y, k))
                        else:
                            of_a, of_b = kernel.self_tile(x, y, zone, k)
                            merge((sid, oid, x.lo), x.lo, of_a)
                            merge((sid, oid, y.lo), y.lo, of_b)
                if len(held) > HELD:
                    for (s, o, _), (lo, found) in held.items():
                        yield _emit(s, o, lo, found)
                    held.clear()
        for (s, o, _), (lo, found) in held.items():
            yield _emit(s, o, lo, found)

    return run


def merge_profiles(parts: DataFrame, k: int) -> DataFrame:
    """One row per window from partial profiles."""
    key = lambda d: F.round(d, kernel.DIGITS).alias("q")
    least = lambda d, j: F.min(F.when(F.col(j).isNotNull(), F.struct(key(d), F.col(j).alias("j"), F.col(d).alias("d"))))
    first = F.element_at("nn", 1)
    near = F.min(F.when(F.size("nn") > 0, F.struct(key(first["d"]), first["j"].alias("j"), first["d"].alias("d")))) if k == 1 else F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("nn")))), 1, k)
    merged = parts.groupBy("series_id", "other_id", "i").agg(near.alias("near"), least("left_d", "left_j").alias("l"), least("right_d", "right_j").alias("r"))
    nn = F.transform(F.filter(F.array("near"), lambda x: x.isNotNull()), lambda x: F.struct(x["d"].alias("d"), x["j"].alias("j"))) if k == 1 else F.col("near")
    return merged.select("series_id", "other_id", "i", nn.alias("nn"), F.col("l.d").alias("left_d"), F.col("l.j").alias("left_j"), F.col("r.d").alias("right_d"), F.col("r.j").alias("right_j"))


def join(a: DataFrame, b: DataFrame, plan: Plan, m: int, block: int, k: int, metric: Metric, zone: int | None, wide: int = 1) -> DataFrame:
    """The profile of every tile's left blocks (self-joins: of both), merged."""
    spark = a.sparkSession
    ship(spark)
    left = a.select("series_id", F.col("blk").alias("a"), F.col("values").alias("va"), F.col("const").alias("ca"))
    right = b.select(F.col("series_id").alias("other_id"), F.col("blk").alias("b"), F.col("values").alias("vb"), F.col("const").alias("cb"))
    rows = plan.tiles.join(left, ["series_id", "a"]).join(right, ["other_id", "b"]).select("series_id", "other_id", "a", "b", "va", "ca", "vb", "cb")
    tasks = max(1, min(plan.count, max(2 * spark.sparkContext.defaultParallelism, plan.count // 16)))
    parts = rows.repartition(tasks).mapInArrow(_run(m, block, wide, k, metric, zone), PROFILE)
    # a block row's parts speak of each other too
    return merge_profiles(parts, k) if plan.deep > 1 or wide > 1 else parts
