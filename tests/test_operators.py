import math

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import approximate, chains, compare, multidim, pan, search, segment, snippets
from tidewheel.operators import profile as P
from tidewheel.plans import kernel
from tidewheel.settings import ZNORM, Metric, Settings
from tidewheel.sources import series as S
from tidewheel.streaming import incremental

X = [584.0, -11, 23, 79, 1001, 0, -19]
SMALL = Settings(block=16)


def dims(spark, rows):
    return spark.createDataFrame([("s", d, i, float(v)) for d, r in enumerate(rows) for i, v in enumerate(r)], "series_id string, dim int, idx long, value double")


def test_match_golden(spark):
    r = search.match(S.from_values(spark, X), [-11.1, 23.4, 79.5, 1001.0]).collect()
    assert [(x["i"], round(x["d"], 10)) for x in r] == [(1, 0.0011129739)]
    r = search.match(S.from_values(spark, [0.0, 1, 0, -1, -1, 0, 1, 0, -0.5]), [0.0, 1, 0], max_distance=0.001).orderBy("i").collect()
    assert [x["i"] for x in r] == [0, 5]
    own = search.match(S.from_values(spark, X), [-11.1, 23.4, 79.5, 1001.0], max_distance=lambda d: d.max(), max_matches=2).orderBy("rank").collect()
    assert own[0]["i"] == 1 and len(own) == 2


def test_motifs(spark):
    t = [0.0, 1, 0, -1, -1, 0, 1, 0, -0.5, 2, 3, 2]
    s = S.from_values(spark, t)
    r = search.motifs(s, P.self_join(s, 3), 3, max_distance=0.001, cutoff=math.inf).orderBy("i").collect()
    assert [x["i"] for x in r] == [0, 5, 9] and max(x["d"] for x in r) < 1e-6


def test_multi_match_is_mean_of_dims(spark):
    rng = np.random.default_rng(0)
    t = rng.uniform(size=(2, 30))
    q = rng.uniform(size=(2, 5))
    d = search.multi_profile(dims(spark, t), q.tolist(), ZNORM).orderBy("i").collect()
    want = np.mean([oracle.matrix(q[n], t[n], 5)[0] for n in range(2)], axis=0)
    assert np.allclose([r["d"] for r in d], want)


def test_chains_fixture(spark):
    right = [11, 7, 4, 7, 6, 11, 8, 11, 10, 10, 11, -1]
    left = [-1, 0, 1, 1, 2, 0, 4, 1, 6, 2, 8, 7]
    p = spark.createDataFrame([("s", i, a, b) for i, (a, b) in enumerate(zip(left, right, strict=True))], "series_id string, i long, left_j long, right_j long")
    got: dict[int, list[int]] = {}
    rows = chains.all_chains(p).orderBy("chain", "pos").collect()
    for r in rows:
        got.setdefault(r["chain"], []).append(r["i"])
    assert sorted(got.values()) == sorted([[1, 7, 11], [0], [3], [9], [2, 4, 6, 8, 10], [5]])
    assert {r["chain"] for r in rows if r["longest"]} == {2}
    assert [r["i"] for r in chains.anchored_chain(p, 4).orderBy("pos").collect()] == [4, 6, 8, 10]


def test_arc_curve_and_regimes(spark):
    rng = np.random.default_rng(6)
    links = rng.integers(0, 50, 50)
    df = spark.createDataFrame([("s", i, int(j)) for i, j in enumerate(links)], "series_id string, i long, j long")
    got = [r["cac"] for r in segment.arc_curve(df, 3, 2).orderBy("i").collect()]
    want = segment.corrected_arcs(links, 3, 2)
    assert np.allclose(got, want)
    at = [r["i"] for r in segment.regimes(segment.arc_curve(df, 3, 2), 3, 3, 2).orderBy("regime").collect()]
    first = int(want.argmin())
    want[max(0, first - 6) : first + 6] = 1
    assert at == [first, int(want.argmin())]


def test_multi_profile_golden(spark):
    s = dims(spark, [X, [1, 2, 4, 8, 16, 0, 32]])
    rows = multidim.multi_profile(s, 3).orderBy("kdim", "i").collect()
    assert np.allclose([r["d"] for r in rows], [0, 1.43947142, 0, 2.69407392, 0.11633857, 0.777905, 2.36179922, 1.50004632, 2.92246722, 0.777905], atol=1e-6)
    assert [r["j"] for r in rows] == [2, 4, 0, 1, 0, 4, 4, 0, 1, 0]
    assert [r["dim"] for r in multidim.subspace(s, 3, 4, 0, 1).orderBy("place").collect()] == [0, 1]
    bits = multidim.description_lengths(s, 3, [0, 0], [2, 4]).orderBy("kdim").collect()
    assert np.allclose([b["bits"] for b in bits], [80, 111.509775])


@pytest.mark.parametrize("include,discords", [(None, False), ([1], False), (None, True), ([2, 0], True)])
def test_multi_profile_brute_force(spark, include, discords):
    t = np.random.default_rng(2).uniform(-1000, 1000, (4, 24))
    each = np.stack([oracle.self_matrix(x, 5, 2) for x in t])
    first = include or []
    rest = np.sort(each[[d for d in range(4) if d not in first]], axis=0)
    want = np.concatenate([each[first], rest[::-1] if discords else rest]).cumsum(axis=0) / np.arange(1, 5)[:, None, None]
    rows = multidim.multi_profile(dims(spark, t), 5, include, discords, settings=Settings(block=32)).orderBy("kdim", "i").collect()
    got = np.array([r["d"] for r in rows]).reshape(4, -1)
    assert np.allclose(got, want.min(axis=2))
    one = multidim.distance_profiles(dims(spark, t), 5, 3, include, discords).orderBy("kdim", "i").collect()
    each = np.stack([oracle.matrix(x, x, 5)[3] for x in t])
    each[:, 3] = 0
    rest = np.sort(each[[d for d in range(4) if d not in first]], axis=0)
    want = np.concatenate([each[first], rest[::-1] if discords else rest]).cumsum(axis=0) / np.arange(1, 5)[:, None]
    assert np.allclose([r["d"] for r in one], want.ravel())


def test_multi_motifs_find_a_planted_pair(spark):
    t = np.random.default_rng(4).uniform(size=(3, 60))
    t[:2, 40:50] = t[:2, 8:18]
    s = dims(spark, t)
    r = multidim.multi_motifs(s, multidim.multi_profile(s, 10), 10, cutoffs=math.inf, k=1, max_matches=2).orderBy("rank").collect()
    assert sorted(x["i"] for x in r) == [8, 40] and sorted(r[0]["subspace"]) == [0, 1]


def test_consensus_golden(spark):
    s = S.from_values(spark, {"0": [584.0, -11, 23, 79, 1001, 0, 19], "1": [600.0, -10, 23, 17], "2": [1.0, 9, 6, 0]})
    r = compare.consensus(s, 3).first()
    assert (round(r["radius"], 6), r["series_id"], r["i"]) == (1.237024, "0", 4)


def test_mpdist(spark):
    a, b = S.from_values(spark, {"a": [-11.1, 23.4, 79.5, 1001.0]}), S.from_values(spark, {"b": X})
    assert compare.mpdist(a, b, 3).first()["mpdist"] == pytest.approx(0.00019935236191097894, abs=1e-9)
    rng = np.random.default_rng(1)
    x, y = rng.uniform(size=20), rng.uniform(size=30)
    d = oracle.matrix(x, y, 5)
    both = np.sort(np.concatenate([d.min(axis=1), d.min(axis=0)]))
    pair = S.from_values(spark, {"a": x.tolist()}), S.from_values(spark, {"b": y.tolist()})
    for pct in (0.05, 0.25, 0.75):
        assert compare.mpdist(*pair, 5, pct).first()["mpdist"] == pytest.approx(both[compare.rank_position(pct, 50, len(both))])
    assert compare.mpdist(*pair, 5, k=2).first()["mpdist"] == pytest.approx(both[2])


def test_snippets_golden(spark):
    found, profiles, regimes = snippets.snippets(S.from_values(spark, X), 3, 2)
    rows = found.orderBy("snippet").collect()
    assert [r["i"] for r in rows] == [0, 3]
    assert np.allclose([r["fraction"] for r in rows], [0.6, 0.4])
    assert np.allclose([r["area"] for r in rows], [9.3441034, 5.81050512])
    d = [r["d"] for r in profiles.orderBy("snippet", "i").collect()]
    assert np.allclose(d, [0, 3.2452632, 3.00009263, 2.982409, 0.11633857, 2.982409, 2.69407392, 3.01719586, 0, 2.92154586], atol=1e-6)
    assert sorted((r["snippet"], r["start"], r["stop"]) for r in regimes.collect()) == [(0, 0, 1), (0, 2, 3), (0, 4, 5), (1, 1, 2), (1, 3, 4)]


def test_sampled_profiles(spark):
    x = np.random.default_rng(3).uniform(size=70).tolist()
    s = S.from_values(spark, x)
    want = oracle.nearest(oracle.self_matrix(x, 5, 2))
    rows = P.nearest(approximate.sampled_profile(s, 5, 0.25, updates=4, settings=SMALL)).orderBy("i").collect()
    assert np.allclose([r["d"] for r in rows], want[0]) and [r["j"] for r in rows] == want[1].tolist()
    part = P.nearest(approximate.sampled_profile(s, 5, 0.25, updates=1, settings=SMALL)).orderBy("i").collect()
    assert all(r["d"] is None or r["d"] >= w - 1e-9 for r, w in zip(part, want[0], strict=True))
    other = S.from_values(spark, {"o": x[:40]})
    ab = P.nearest(approximate.sampled_profile(s, 5, 0.5, updates=2, other=other, settings=SMALL)).orderBy("i").collect()
    assert np.allclose([r["d"] for r in ab], oracle.matrix(x, x[:40], 5).min(axis=1))
    whole = P.nearest(approximate.extended_profile(s, 5, 1, settings=SMALL)).orderBy("i").collect()
    assert np.allclose([r["d"] for r in whole], want[0])
    rows = lambda p: [(r["i"], r["rank"], r["j"]) for r in P.flat(p).orderBy("i", "rank").collect()]
    assert rows(approximate.extended_profile(s, 5, 1, k=3, settings=SMALL)) == rows(P.self_join(s, 5, k=3))


def test_pan(spark):
    assert pan.refining_order(7) == [3, 1, 5, 0, 2, 4, 6]
    s = S.from_values(spark, np.random.default_rng(3).uniform(size=40).tolist())
    sizes = pan.window_sizes(40, 4, 8, 2)
    assert sizes == [6, 4, 8]
    p = pan.pan_profile(s, 4, 8, 2, updates=1)
    rows = pan.pan_matrix(p, sizes, 40).orderBy("m", "i").collect()
    assert len(rows) == 3 * 40 and {r["value"] for r in rows} <= {0.0, 1.0}
    # sizes above the only one processed have no distance of their own
    assert len({(r["m"], r["value"]) for r in rows if r["m"] == 8}) == 1


def test_incremental_profile_equals_batch():
    t = np.random.default_rng(1).uniform(size=64)
    own = incremental.IncrementalProfile(t[:30], 3, egress=False, k=2)
    for v in t[30:]:
        own.update(v)
    want = kernel.self_profile(t, 3, ZNORM, 1, 2)
    assert np.allclose(own.d, want.near.d) and (own.j == want.near.j).all()
    assert np.allclose(own.left_d, want.left.d[:, 0])
    own = incremental.IncrementalProfile([584.0, -11, 23, 79, 1001, 0], 3)
    own.update(-19.0)
    assert np.allclose(own.left_d, [np.inf, 3.00009263, 2.69407392, 3.05656417]) and own.left_j.tolist() == [-1, 0, 1, 2]


def test_segmenter():
    own = incremental.Segmenter([584.0, -11, 23, 79, 1001, 0], 3, 3)
    assert own.update(19.0).tolist() == [1, 1, 1, 1]
    t = np.random.default_rng(1).uniform(size=64)
    own = incremental.Segmenter(t[:30], 5, 5, 1, metric=Metric(2.0))
    for v in t[30:]:
        own.update(v)
    assert own.gone == 34 and len(own.curve) == 26 and own.values.tolist() == t[34:].tolist()


def test_recipes(spark):
    rng = np.random.default_rng(7)
    s = S.from_values(spark, rng.uniform(size=40).tolist())
    av = compare.complexity(s, 5)
    values = [r["av"] for r in av.collect()]
    assert min(values) == 0 and max(values) == 1 and len(values) == 36
    p = P.nearest(P.self_join(s, 5)).select("series_id", "i", "d")
    top = p.agg(F.max("d")).first()[0]
    rows = compare.annotate(p, av).join(p.withColumnRenamed("d", "old"), ["series_id", "i"]).join(av, ["series_id", "i"]).collect()
    assert all(abs(r["d"] - (r["old"] + (1 - r["av"]) * top)) < 1e-9 for r in rows)


def test_sampled_topk_equals_join(spark):
    s = S.from_values(spark, np.random.default_rng(11).uniform(size=50).tolist())
    rows = lambda p: [(r["i"], r["rank"], r["j"]) for r in P.flat(p).orderBy("i", "rank").collect()]
    assert rows(approximate.sampled_profile(s, 5, 0.5, updates=2, k=3, settings=SMALL)) == rows(P.self_join(s, 5, k=3))


def test_anytime_profile_only_improves(spark):
    x = np.random.default_rng(12).uniform(size=60).tolist()
    s = S.from_values(spark, x)
    best = oracle.nearest(oracle.self_matrix(x, 5, 2))[0]
    start = [r["d"] for r in P.nearest(approximate.extended_profile(s, 5, settings=SMALL)).orderBy("i").collect()]
    both = [r["d"] for r in P.nearest(approximate.anytime_profile(s, 5, 0.25, settings=SMALL)).orderBy("i").collect()]
    assert all(b - 1e-9 <= y <= x + 1e-9 for b, y, x in zip(best, both, start, strict=True))


def test_streams_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = {"a": rng.uniform(size=40).tolist(), "b": rng.uniform(size=30).tolist()}
    rows = [(s, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", v) for s, vs in values.items() for i, v in enumerate(vs)]
    points = spark.createDataFrame(rows, "series_id string, t string, value double").select("series_id", F.to_timestamp("t").alias("ts"), "value")
    for part in (points.where("ts < '2024-01-01 00:00:20'"), points.where("ts >= '2024-01-01 00:00:20'")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = incremental.profile_stream(source, 5, 1000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r["series_id"], r["i"]): (r["d"], r["j"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    for name, vs in values.items():
        left = kernel.self_profile(np.array(vs), 5, ZNORM, 2).left
        for (s, i), (d, j) in got.items():
            if s == name:
                assert (j is None and left.j[i, 0] < 0) or (j == left.j[i, 0] and abs(d - left.d[i, 0]) < 1e-9)
    assert len(got) >= 60 - 8


@pytest.mark.parametrize("metric", [ZNORM])
def test_consensus_drops_what_cannot_win(spark, metric):
    rng = np.random.default_rng(21)
    n, m, length = 10, 8, 160
    shape = np.sin(np.arange(m)) * 3
    values = {f"s{k}": rng.normal(size=length) for k in range(n)}
    for k, v in enumerate(values.values()):
        v[10 * k + 5 : 10 * k + 5 + m] = shape + 0.05 * rng.normal(size=m)
    parts = [S.from_values(spark, v.tolist()).withColumn("series_id", F.lit(k)) for k, v in values.items()]
    s = parts[0]
    for p in parts[1:]:
        s = s.unionByName(p)
    s = s.coalesce(1).cache()
    joined = []
    row = compare.consensus(s, m, metric, Settings(block=128), few=0, joined=joined).first()
    best = None
    for a, x in values.items():
        near = np.stack([oracle.matrix(x, y, m, metric.p).min(axis=1) for b, y in values.items() if b != a])
        for i, (radius, total) in enumerate(zip(near.max(axis=0), near.sum(axis=0), strict=True)):
            best = min(best or (np.inf,), (radius, total / n, a, i))
    assert (row["series_id"], row["i"]) == best[2:] and abs(row["radius"] - best[0]) < 1e-7 and abs(row["mean"] - best[1]) < 1e-7
    blocks = -(-(length - m + 1) // 16)
    assert sum(joined) <= n * (n - 1) * blocks**2 / 2


@pytest.mark.parametrize("metric,k", [(ZNORM, 1), (Metric(2.0), 1), (Metric(3.0), 1), (ZNORM, 2)])
def test_updates_carry_a_sample_on(spark, metric, k):
    x = np.random.default_rng(13).normal(size=150)
    x[40:60] = 1.5
    x[[5, 90]] = np.nan
    s = S.from_values(spark, x.tolist())
    small = Settings(block=32)
    kept = approximate.sampled_profile(s, 6, 0.25, 1, k=k, metric=metric, settings=small).cache()
    for done in range(1, 4):
        kept = approximate.updated_profile(kept, s, 6, done, 1, 0.25, k=k, metric=metric, settings=small).cache()
        whole = approximate.sampled_profile(s, 6, 0.25, done + 1, k=k, metric=metric, settings=small)
        a, b = ({r["i"]: r for r in df.collect()} for df in (kept, whole))
        for i in a:
            assert [n["j"] for n in a[i]["nn"]] == [n["j"] for n in b[i]["nn"]] and a[i]["right_j"] == b[i]["right_j"]
    low, j = oracle.nearest(oracle.self_matrix(x, 6, 2, metric.p))
    got = P.nearest(kept).orderBy("i").collect()
    for r in got:
        assert (r["j"] is None) == (j[r["i"]] < 0) and (r["j"] is None or abs(r["d"] - low[r["i"]]) < 3e-5)
    one = approximate.sampled_profile(s, 6, 0.5, 1, s, k, metric, small)
    both = approximate.updated_profile(one, s, 6, 1, 1, 0.5, s, k, metric, small)
    assert all(r["nn"][0]["d"] < 1e-4 for r in both.collect() if r["nn"])


def test_numbering_by_ranges_and_by_windows(spark, monkeypatch):
    rng = np.random.default_rng(17)
    rows = [(("long" if n < 700 else f"s{n % 9}"), float(rng.integers(0, 200)), n) for n in range(900)]
    df = spark.createDataFrame(rows, "key string, o double, tie long").repartition(5)
    of = lambda: {(r["key"], r["tie"]): r["at"] for r in S_numbered(df, ["key"], ["o", "tie"], "at").collect()}
    from tidewheel.sources import series as module

    S_numbered = module.numbered
    windows = of()
    monkeypatch.setattr(module, "SHORT", 10)
    assert of() == windows
    for key in {k for k, _, _ in rows}:
        own = sorted((o, t) for k, o, t in rows if k == key)
        assert [windows[key, t] for _, t in own] == list(range(len(own)))
