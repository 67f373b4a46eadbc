import numpy as np

from tidewheel.functions import windows as W
from tidewheel.sources import series as S


def test_rolling_flags_and_missing(spark):
    x = [1.0, 1, 1, float("inf"), 2, 3, None, 4, 5, 6]
    s = S.from_values(spark, x)
    r = W.rolling(s, 3).orderBy("i").collect()
    assert [w["is_finite"] for w in r] == [True, False, False, False, False, False, False, True]
    assert r[0]["is_const"] and not r[7]["is_const"] and r[1]["mu"] is None and r[7]["mu"] == 5
    p = W.rolling_present(s, 3).orderBy("i").collect()
    assert [w["n"] for w in p] == [3, 2, 2, 2, 2, 2, 2, 3] and p[5]["low"] == 3 and p[5]["high"] == 4


def test_arrays_and_dot_products(spark):
    x = np.random.default_rng(0).uniform(size=12)
    s = S.from_values(spark, x.tolist())
    assert [w["a"] for w in W.windows(s, 4).orderBy("i").collect()] == [x[i : i + 4].tolist() for i in range(9)]
    qt = [r["qt"] for r in W.sliding_dot(s, [1.0, 2.0, 3.0]).orderBy("i").collect()]
    assert np.allclose(qt, np.convolve(x, [3, 2, 1], "valid"))


def test_runs_and_zone(spark):
    flags = [1, 1, 0, 1, 0, 0, 1, 1]
    df = spark.createDataFrame([("s", i, bool(f)) for i, f in enumerate(flags)], "series_id string, i long, flag boolean")
    assert sorted((r["start"], r["stop"]) for r in W.runs(df).collect()) == [(0, 2), (3, 4), (6, 8)]
    d = spark.createDataFrame([("s", i, 1.0) for i in range(6)], "series_id string, i long, d double")
    assert [r["d"] for r in W.zone_mask(d, 2, 1).orderBy("i").collect()] == [1, None, None, None, 1, 1]


def test_sources(spark, tmp_path):
    s = S.from_values(spark, {"a": [1.0, 2.0], "b": [3.0]})
    S.write_result(s, f"{tmp_path}/x", "json")
    back = S.read_series(spark, f"{tmp_path}/x", "idx", "value", ["series_id"], "json")
    assert sorted(map(tuple, back.collect())) == [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)]
    wide = spark.createDataFrame([(0, 1.0, 5.0), (1, 2.0, 6.0)], "t long, x double, y double")
    assert sorted(map(tuple, S.wide_to_dims(wide, "t", ["x", "y"], "w").collect())) == [("w", 0, 0, 1.0), ("w", 0, 1, 2.0), ("w", 1, 0, 5.0), ("w", 1, 1, 6.0)]
    arrays = spark.createDataFrame([(7, [1.0, 2.0])], "k long, v array<float>")
    assert sorted(map(tuple, S.arrays_to_series(arrays, "k", "v").collect())) == [("7", 0, 1.0), ("7", 1, 2.0)]
