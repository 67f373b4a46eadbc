"""The recurrence kernel against brute force, and its bounds of time and memory."""

import time
import tracemalloc

import numpy as np
import pytest

from tests import oracle
from tidewheel.operators import compare
from tidewheel.operators import profile as P
from tidewheel.plans import kernel, tiles
from tidewheel.settings import ZNORM, Metric
from tidewheel.sources import series as S

L1, L2, L3 = Metric(1.0), Metric(2.0), Metric(3.0)


def made(kind, n, rng):
    if kind == "walk":
        return 1e4 + rng.normal(size=n).cumsum()
    if kind == "periodic":
        return np.tile(rng.normal(size=23), n // 23 + 1)[:n]
    if kind == "steps":
        return rng.integers(0, 3, n).astype(float)
    x = rng.normal(size=n)
    if kind == "quiet":  # some windows a millionth as loud as others
        x[n // 3 : n // 2] *= 1e-6
    if kind == "flat":
        x[20:60] = 3.0
        x[90:120] = -1.0
        x[[5, n - 20]] = np.nan
    return x


@pytest.mark.parametrize("kind", ["noise", "walk", "periodic", "steps", "quiet", "flat"])
@pytest.mark.parametrize("metric", [ZNORM, L1, L2, L3])
def test_tiles_equal_brute_force(kind, metric, monkeypatch):
    monkeypatch.setattr(kernel, "RESTART", 16)
    rng = np.random.default_rng(3)
    m, zone = 9, 3
    x, y = made(kind, 170, rng), made(kind, 90, rng)
    near = 3e-5 if metric.p == 3 else 2e-6  # sums of powers below 1e-14 count as 0
    d = oracle.self_matrix(x, m, zone, metric.p)
    other = oracle.matrix(x, y, m, metric.p)
    n, cut = len(d), 71  # two parts, as blocks of a tile plan
    for k in (1, 3):
        parts = [kernel.prepare(x[lo : hi + m - 1], m, metric, lo) for lo, hi in ((0, cut), (cut, n))]
        found = kernel.Best(n, k), kernel.Best(n, 1), kernel.Best(n, 1)
        for p, q in ((0, 0), (0, 1), (1, 1)):
            for side, of in zip((parts[p], parts[q]), kernel.self_tile(parts[p], parts[q], zone, k), strict=True):
                for whole, part in zip(found, (of.near, of.left, of.right), strict=True):
                    whole.offer(slice(side.lo, side.lo + len(side)), part.d, part.j)
        left, right = np.tril(np.ones((n, n), bool)), np.triu(np.ones((n, n), bool))
        for best, far in zip(found, (d, np.where(left, d, np.inf), np.where(right, d, np.inf)), strict=True):
            want = np.sort(far, axis=1)[:, : best.d.shape[1]]
            np.testing.assert_allclose(np.where(best.j < 0, np.inf, best.d), want, atol=near)
            there = best.j >= 0
            np.testing.assert_allclose(far[np.arange(n)[:, None], np.maximum(best.j, 0)][there], best.d[there], atol=near)
        ab = kernel.ab_profile(x, y, m, metric, k).near
        np.testing.assert_allclose(np.where(ab.j < 0, np.inf, ab.d), np.sort(other, axis=1)[:, :k], atol=near)
    if kind in ("periodic", "steps"):  # of equal distances the first
        nearest = kernel.self_profile(x, m, metric, zone).near
        equal = np.round(d, 7)
        assert (nearest.j[:, 0] == equal.argmin(axis=1)).all()


def test_long_windows_cost_what_short_ones_do():
    x = np.random.default_rng(1).normal(size=2 * 4096 + 1023)

    def seconds(m):
        a, b = kernel.prepare(x[: 4096 + m - 1], m, ZNORM), kernel.prepare(x[4096 : 8192 + m - 1], m, ZNORM, 4096)
        start = time.process_time()
        kernel.self_tile(a, b, m // 4, 1)
        return time.process_time() - start

    seconds(50)
    assert min(seconds(1024) for _ in range(3)) < 3 * min(seconds(50) for _ in range(3))  # 1.2 to 1.5 at full blocks


def test_a_row_of_work_is_bounded():
    m, block, wide = 1024, 2048, 8
    x = np.random.default_rng(2).normal(size=wide * block + m - 1)
    tracemalloc.start()
    xs = tiles._parts(x, None, m, ZNORM, block, 0)
    ys = tiles._parts(x, None, m, ZNORM, block, 10**6)
    for p in xs[:2]:
        kernel.self_tile(p, ys[0], m // 4, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and len(xs) == wide


@pytest.mark.parametrize("metric", [ZNORM, L2])
def test_long_query(spark, metric):
    rng = np.random.default_rng(4)
    x = rng.normal(size=40_000).cumsum()
    m = 5000
    x[30_000 : 30_000 + m] = x[10_000 : 10_000 + m] + (0 if metric.p else 7.0)  # a copy, elsewhere
    q = x[10_000 : 10_000 + m]
    rows = {r["i"]: r["d"] for r in P.distance_profile(S.from_values(spark, x.tolist()), q.tolist(), metric, 10_000).collect()}
    assert len(rows) == 35_001 and rows[10_000] == 0.0 and rows[30_000] < 1e-5
    for i in (0, 1, 8191, 8192, 9_999, 20_000, 35_000):
        assert abs(rows[i] - oracle.distance(q, x[i : i + m], metric.p)) < 1e-6 * max(1, rows[i])


def test_sliding_products_by_transforms():
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=30_000), rng.normal(size=700)
    np.testing.assert_allclose(kernel._correlate(x, q), np.correlate(x, q, "valid"), atol=1e-10)
    assert len(kernel._correlate(x[:700], q)) == 1


def test_rank_with_outliers(spark, monkeypatch):
    monkeypatch.setattr(compare, "RANKED", 20)
    rng = np.random.default_rng(6)
    values = {"a": [*rng.uniform(1, 2, 3000), 1e300, 1e-300, -1e300], "b": [3.0] * 500 + [4.0], "c": [0.0, -0.0, -2.5, *(-rng.exponential(size=900))], "d": [5.0]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None)], "key string, d double")
    for at in (0, 1, 470, 1500, 10**6):
        ranks = spark.createDataFrame([(k, at) for k in values], "key string, at long")
        got = {r["key"]: r["d"] for r in compare.kth_smallest(df, ["key"], ranks).collect()}
        assert got == {k: sorted(vs)[min(at, len(vs) - 1)] for k, vs in values.items()}
