"""The greedy choice over blocks against the plain one."""

import numpy as np
import pytest

from tidewheel.plans import greedy


def plain(i, key, zone):
    taken = []
    for n in np.lexsort((i, key)):
        if all(abs(int(i[n]) - t) > zone for t in taken):
            taken.append(int(i[n]))
    return set(taken)


@pytest.mark.parametrize("shape", ["random", "rising", "ties", "valleys"])
def test_rows_apart(spark, shape):
    rng = np.random.default_rng(7)
    i = np.sort(rng.choice(4000, 1500, replace=False))
    key = {"random": rng.normal(size=len(i)), "rising": i / 7.0, "ties": rng.integers(0, 3, len(i)).astype(float), "valleys": np.sin(i / 40.0)}[shape]
    key[3] = -np.inf
    rows = [("a", int(p), float(k), float(k)) for p, k in zip(i, key, strict=True)] + [("b", 5, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, i long, d double, key double")
    for zone, block in ((0, 64), (5, 64), (30, 100), (700, 64)):
        got = {(r["series_id"], r["i"]) for r in greedy.apart(df, zone, block).collect()}
        assert got == {("b", 5)} | {("a", p) for p in plain(i, key, zone)}
    assert greedy.apart(df.where("false"), 5).count() == 0


def test_least_rows_of_blocks(spark):
    rng = np.random.default_rng(8)
    key = rng.integers(0, 50, 900)
    df = spark.createDataFrame([("a", n, 0.0, float(k)) for n, k in enumerate(key)], "series_id string, i long, d double, key double")
    got = {r["i"] for r in greedy.least(df, 37, 100).collect()}
    assert got == set(np.lexsort((np.arange(900), key))[:37].tolist())
