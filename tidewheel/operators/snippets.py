"""Snippets: the windows of a series that represent it best."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.windows import numbered_runs
from tidewheel.operators.profile import Flags, constant_flags
from tidewheel.plans import kernel, tiles
from tidewheel.runtime import cut, ship
from tidewheel.settings import DEFAULT, ZNORM, Metric, Settings


def mpdist_vector(query: np.ndarray, values: np.ndarray, s: int, metric: Metric = ZNORM, percentage: float = 0.05, k: int | None = None, query_constant: np.ndarray | None = None, constant: np.ndarray | None = None) -> np.ndarray:
    """MPdist of a query to each window of its length, over windows of ``s`` points; inf where there is none."""
    size = len(query)
    q, t = kernel.prepare(query, s, metric, 0, query_constant), kernel.prepare(values, s, metric, 0, constant)
    d = kernel.full(q, t)
    j = size - s + 1
    span = np.lib.stride_tricks.sliding_window_view(d, j, axis=1)
    rows = span.min(axis=2).T  # nearest place of each part of the query, for each start
    cols = np.lib.stride_tricks.sliding_window_view(d.min(axis=0), j)
    both = np.sort(np.concatenate([rows, cols], axis=1), axis=1)
    at = min(math.ceil(percentage * 2 * size), 2 * j - 1) if k is None else min(k, 2 * j - 1)
    out = both[:, at].copy()
    for n in np.flatnonzero(np.isinf(out)).tolist():
        finite = both[n, : at + 1][np.isfinite(both[n, : at + 1])]
        if len(finite):
            out[n] = finite[-1]
    return out


def mpdist_profiles(series: DataFrame, m: int, s: int | None = None, percentage: float = 1.0, mpdist_percentage: float = 0.05, k: int | None = None, metric: Metric = ZNORM, settings: Settings = DEFAULT, constant: Flags = None) -> DataFrame:
    """series_id, chunk, i, d: MPdist of every whole chunk of ``m`` points to every window of ``m`` points.

    A row of work is a chunk and a block of windows; both are a few thousand points, whatever the series' length.
    """
    ship(series.sparkSession)
    s = min(math.ceil(percentage * m), m) if s is None else s
    block = max(settings.block // 8, m)
    flags = constant_flags(series, s, constant)  # of the sub-windows
    blocks = tiles.block_rows(series, m, block, flags)
    n = series.groupBy("series_id").agg((F.max("idx") + 1).alias("n"))
    flagged = series.withColumn("is_const", F.lit(None).cast("boolean")) if flags is None else series.join(flags.select("series_id", F.col("i").alias("idx"), "is_const"), ["series_id", "idx"], "left")
    numbered = flagged.select("series_id", F.floor(F.col("idx") / m).cast("long").alias("chunk"), F.struct("idx", "value", "is_const").alias("p"))
    chunks = numbered.groupBy("series_id", "chunk").agg(F.sort_array(F.collect_list("p")).alias("p")).where(F.size("p") == m).select("series_id", "chunk", F.transform("p", lambda x: x["value"]).alias("query"), F.transform("p", lambda x: x["is_const"]).alias("query_const"))
    # each chunk goes to each block of its series by their numbers
    dealt = chunks.join(n, "series_id").withColumn("blk", F.explode(F.expr(f"sequence(0L, CAST(ceil((n - {m} + 1) / {block}) AS BIGINT) - 1)")))
    work = dealt.join(blocks, ["series_id", "blk"]).select("series_id", "chunk", "blk", "query", "values", "query_const", "const")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda c, r: c[r].values.to_numpy(zero_copy_only=False).astype(float)
        for batch in batches:
            for r in range(batch.num_rows):
                sid, chunk, blk = (batch.column(c)[r].as_py() for c in range(3))
                query, values = of(batch.column(3), r), of(batch.column(4), r)
                own = [tiles._flags(batch.column(c), r, len(x) - s + 1) for c, x in ((5, query), (6, values))]
                d = mpdist_vector(query, values, s, metric, mpdist_percentage, k, *own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sid] * len(d)), pa.array(np.full(len(d), chunk)), pa.array(blk * block + np.arange(len(d))), pa.array(d, mask=np.isinf(d))], names=["series_id", "chunk", "i", "d"]
                )

    return work.repartition(4 * series.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "series_id string, chunk long, i long, d double")


def snippets(series: DataFrame, m: int, k: int, s: int | None = None, percentage: float = 1.0, mpdist_percentage: float = 0.05, mpdist_k: int | None = None, metric: Metric = ZNORM, settings: Settings = DEFAULT, constant: Flags = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snippets, profiles, regimes) of each series.

    snippets: series_id, snippet, i, area, fraction; profiles: series_id, snippet, i, d; regimes: series_id, snippet,
    start, stop (exclusive). Each of the k rounds picks the chunk with the least area under the least profile so far;
    equal areas go to the first chunk, and a position belongs to the first snippet that is nearest.
    """
    inf = float(np.finfo(float).max) ** 0.5
    all_d = cut(mpdist_profiles(series, m, s, percentage, mpdist_percentage, mpdist_k, metric, settings, constant).withColumn("d", F.coalesce("d", F.lit(inf))))
    current = cut(all_d.groupBy("series_id", "i").agg(F.lit(inf).alias("least")))
    picked = None
    for n in range(k):
        areas = all_d.join(current, ["series_id", "i"]).groupBy("series_id", "chunk").agg(F.sum(F.least("d", "least")).alias("area"))
        best = cut(areas.groupBy("series_id").agg(F.min(F.struct("area", "chunk")).alias("b")).select("series_id", F.lit(n).alias("snippet"), "b.chunk", "b.area"))
        picked = best if picked is None else picked.unionAll(best)
        current = cut(all_d.join(best, ["series_id", "chunk"]).join(current, ["series_id", "i"]).select("series_id", "i", F.least("d", "least").alias("least")))
    profiles = cut(all_d.join(picked, ["series_id", "chunk"]).select("series_id", "snippet", "i", "d"))
    owner = profiles.groupBy("series_id", "i").agg(F.min(F.struct("d", "snippet"))["snippet"].alias("snippet"))
    share = owner.groupBy("series_id", "snippet").agg(F.count(F.lit(1)).alias("own"))
    total = owner.groupBy("series_id").agg(F.count(F.lit(1)).alias("all"))
    described = (
        picked.join(share, ["series_id", "snippet"], "left")
        .join(total, "series_id")
        .select("series_id", "snippet", (F.col("chunk") * m).alias("i"), "area", (F.coalesce("own", F.lit(0)) / F.col("all")).alias("fraction"))
    )
    islands = numbered_runs(cut(owner), F.col("x.snippet") == F.col("y.snippet"))
    spans = islands.groupBy("series_id", "snippet", "run").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop")).drop("run")
    return described, profiles, spans
