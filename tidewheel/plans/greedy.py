"""The greedy choice of rows that keep apart, as rounds over blocks.

One after the other, by ascending key and then position, a row is taken unless a taken one is within the zone. A block of
positions with a halo settles all of its rows whose fate doesn't hang on rows that it can't see: a row is taken if it sees
its whole zone and nothing in it is taken or open, and it is gone if something in it is taken. What stays open goes into
another round with the rows taken so far. The least open row of a series is settled in every round, and a chain of rows that
hang on each other costs a round for each border that it crosses, not one for each of its links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.runtime import cut, last_cut, remove, ship

#: Positions of a block.
BLOCK = 8192


def _settle(zone: int, size: int, reach: int):
    """Rows of a block and its halo to the block's own rows, without those that are gone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf.blk.iloc[0]) * size - reach
        span = size + 2 * reach
        at, taken = pdf.i.to_numpy() - base, pdf.taken.to_numpy(bool)
        state = np.zeros(span, np.int8)  # 1: taken, 2: open
        for n in np.lexsort((at, pdf.key.to_numpy(), ~taken)).tolist():
            p = int(at[n])
            seen = state[max(0, p - zone) : p + zone + 1]
            if taken[n]:
                state[p] = 1
            elif not (seen == 1).any():
                whole = (p >= zone or base + p < zone) and p + zone < span
                state[p] = 1 if whole and not seen.any() else 2
        mine = (at >= reach) & (at < reach + size) & (state[at] > 0)
        return pdf[mine].assign(taken=state[at[mine]] == 1).drop(columns="blk")

    return run


def apart(rows: DataFrame, zone: int, block: int = BLOCK) -> DataFrame:
    """series_id, i, d, key of the rows (series_id, i, d, key) that the choice by (key, i) takes, none within ``zone`` of another.

    A position has one row at most.
    """
    spark = rows.sparkSession
    ship(spark)
    size, reach = max(block, 4 * zone + 1), 2 * zone + 1
    names = ["series_id", "i", "d", "key"]
    state = rows.select(F.col("series_id").cast("string").alias("series_id"), F.col("i").cast("long").alias("i"), F.col("d").cast("double").alias("d"), F.col("key").cast("double").alias("key"), F.lit(False).alias("taken"))
    old = None
    while True:
        first, last = F.greatest(F.lit(0), F.floor((F.col("i") - reach) / size)), F.floor((F.col("i") + reach) / size)
        spread = state.withColumn("blk", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        state = cut(spread.groupBy("series_id", "blk").applyInPandas(_settle(zone, size, reach), "series_id string, i long, d double, key double, taken boolean"))
        if old is not None:
            remove(spark, old)
        old = last_cut()
        if state.where("NOT taken").isEmpty():
            return state.select(*names)


def least(rows: DataFrame, n: int, block: int = 1 << 16) -> DataFrame:
    """The ``n`` rows of each series that are first by (key, i): of each block of positions, then of these."""
    place = F.row_number()
    of_block = Window.partitionBy("series_id", F.floor(F.col("i") / block)).orderBy("key", "i")
    few = rows.withColumn("_n", place.over(of_block)).where(F.col("_n") <= n)
    return few.withColumn("_n", place.over(Window.partitionBy("series_id").orderBy("key", "i"))).where(F.col("_n") <= n).drop("_n")
