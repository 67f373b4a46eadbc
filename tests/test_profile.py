import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import profile as P
from tidewheel.settings import Metric, Settings, check_window, largest_window
from tidewheel.sources import series as S

X = [584.0, -11, 23, 79, 1001, 0, -19]
SMALL = Settings(block=16)


def table(p, columns=("i", "d", "j")):
    rows = P.nearest(p).orderBy("i").collect()
    return [np.array([np.inf if (v := r[c]) is None and c == "d" else -1 if v is None else v for r in rows]) for c in columns]


def test_golden(spark):
    p = P.self_join(S.from_values(spark, X), 3)
    i, d, j, left, right = table(p, ("i", "d", "j", "left_j", "right_j"))
    assert np.allclose(d, [0.11633857, 2.69407392, 3.00009263, 2.69407392, 0.11633857])
    assert j.tolist() == [4, 3, 0, 1, 0]
    assert left.tolist() == [-1, -1, 0, 1, 0]
    assert right.tolist() == [4, 3, 4, -1, -1]


@pytest.mark.parametrize("p", [None, 1.0, 2.0, 3.0])
@pytest.mark.parametrize("hole", ["none", "first", "last", "slice", "pair"])
def test_self_join_matches_brute_force(spark, p, hole):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1000, 1000, 64)
    x[40:52] = 7.0
    for at in {"none": [], "first": [0], "last": [-1], "slice": [1, 2], "pair": [0, 3]}[hole]:
        x[at] = np.nan if at != 3 else np.inf
    d = oracle.self_matrix(x, 8, 2, p)
    want = oracle.nearest(d)
    _, got, j = table(P.self_join(S.from_values(spark, x.tolist()), 8, metric=Metric(p), settings=SMALL))
    assert np.allclose(got, want[0])
    assert np.allclose(d[np.arange(len(j))[j >= 0], j[j >= 0]], got[j >= 0])
    assert ((j < 0) == (want[1] < 0)).all()


def test_strategies_agree(spark):
    x = np.random.default_rng(5).uniform(size=80).tolist()
    s = S.from_values(spark, x)
    for k in (1, 3):
        a = P.flat(P.self_join(s, 5, k=k, settings=SMALL)).orderBy("i", "rank").collect()
        b = P.flat(P.self_join(s, 5, k=k, strategy="sql")).orderBy("i", "rank").collect()
        assert [(r["i"], r["rank"], r["j"]) for r in a] == [(r["i"], r["rank"], r["j"]) for r in b]
        assert np.allclose([r["d"] for r in a], [r["d"] for r in b])


def test_ab_join_and_many_series(spark):
    rng = np.random.default_rng(9)
    a, b, c = rng.uniform(size=30), rng.uniform(size=50), rng.uniform(size=41)
    p = P.ab_join(S.from_values(spark, {"a": a.tolist()}), S.from_values(spark, {"b": b.tolist(), "c": c.tolist()}), 6, settings=SMALL)
    for name, other in (("b", b), ("c", c)):
        want = oracle.nearest(oracle.matrix(a, other, 6))
        _, d, j = table(p.where(F.col("other_id") == name))
        assert np.allclose(d, want[0]) and j.tolist() == want[1].tolist()


def test_constant_and_identical_windows(spark):
    x = [0.0] * 20 + [1.0] * 5
    _, d, _ = table(P.self_join(S.from_values(spark, x), 3))
    assert np.allclose(d, oracle.nearest(oracle.self_matrix(x, 3, 1))[0])
    block = np.random.default_rng(1).uniform(size=8)
    y = np.random.default_rng(2).uniform(size=20)
    y[1:9] = y[11:19] = block
    _, d, j = table(P.self_join(S.from_values(spark, y.tolist()), 4))
    assert d[1] == 0 and j[1] == 11


def test_constant_override(spark):
    x = np.random.default_rng(4).uniform(size=40)
    s = S.from_values(spark, x.tolist())
    flat = lambda a, m: np.lib.stride_tricks.sliding_window_view(a, m).std(axis=1) <= np.quantile(np.lib.stride_tricks.sliding_window_view(a, m).std(axis=1), 0.1)
    flags = flat(x, 5)
    _, d, _ = table(P.self_join(s, 5, constant=flat))
    want = oracle.self_matrix(x, 5, 2)
    for i in range(len(flags)):
        for j in range(len(flags)):
            if np.isfinite(want[i, j]) and (flags[i] or flags[j]):
                want[i, j] = 0 if flags[i] and flags[j] else 5**0.5
    assert np.allclose(d, want.min(axis=1))


def test_distance_profile_golden(spark):
    q = [-11.1, 23.4, 79.5, 1001.0]
    d = [r["d"] for r in P.distance_profile(S.from_values(spark, X), q).orderBy("i").collect()]
    assert np.allclose(d, [3.18792463, 0.00111297393, 3.23874018, 3.34470195])
    assert all(r["d"] is None for r in P.distance_profile(S.from_values(spark, X), [1.0, float("nan"), 2.0]).collect())


def test_rebuilt_distances_and_discords(spark):
    x = np.random.default_rng(8).uniform(size=60).tolist()
    s = S.from_values(spark, x)
    p = P.self_join(s, 6)
    again = P.from_indices(P.nearest(p), s, 6).orderBy("i").collect()
    assert np.allclose([r["d"] for r in again], table(p)[1])
    found = P.discords(p, 6, k=2).orderBy("rank").collect()
    assert found[0]["d"] == pytest.approx(table(p)[1].max())
    assert abs(found[0]["i"] - found[1]["i"]) > 2


def test_window_checks():
    with pytest.raises(ValueError):
        check_window(2, 10)
    with pytest.raises(ValueError):
        check_window(11, 10)
    assert largest_window(64) == 64 - 13 - 1


def test_empty_series_has_no_rows(spark):
    s = S.from_values(spark, {})
    assert P.self_join(s, 4).count() == 0
    assert P.self_join(S.from_values(spark, [1.0, 2.0]), 4).count() == 0


@pytest.mark.parametrize("p", [None, 2.0])
def test_wide_block_rows(spark, p, monkeypatch):
    """Rows of several parts give the profile that rows of one part give."""
    from tidewheel.plans import tiles

    rng = np.random.default_rng(3)
    s = S.from_values(spark, {"a": rng.uniform(size=150).tolist(), "b": rng.uniform(size=40).tolist()})
    other = S.from_values(spark, {"c": rng.uniform(size=90).tolist()})
    settings, metric = Settings(block=16), Metric(p)

    def rows(df):
        return sorted(map(str, df.collect()))

    plain = rows(P.self_join(s, 8, k=2, metric=metric, settings=settings)), rows(P.ab_join(s, other, 8, metric=metric, settings=settings))
    monkeypatch.setattr(tiles, "width", lambda n, cores: 3)
    assert plain == (rows(P.self_join(s, 8, k=2, metric=metric, settings=settings)), rows(P.ab_join(s, other, 8, metric=metric, settings=settings)))


def test_arguments_are_checked(spark):
    s = S.from_values(spark, [1.0, 2, 3, 4, 5, 6])
    for call in (lambda: P.self_join(s, 2), lambda: P.self_join(s, 3, k=0), lambda: P.self_join(s, 3, metric=Metric(0.5)), lambda: P.ab_join(s, s, 3, k=0)):
        with pytest.raises(ValueError):
            call()
