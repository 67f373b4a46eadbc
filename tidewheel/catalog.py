"""Registered queries of the matrix-profile engine and their DuckDB oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.windows import rolling, rolling_present, sliding_dot
from tidewheel.operators import approximate, chains, compare, multidim, pan, search, segment, snippets
from tidewheel.operators import profile as P
from tidewheel.runtime import cut, shared_folder
from tidewheel.settings import Metric
from tidewheel.sources import series as S
from tidewheel.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL pieces

QUANTITY = "SELECT 'quantity' AS series_id, row_number() OVER (ORDER BY d) - 1 AS idx, v AS value FROM (SELECT l_shipdate AS d, sum(l_quantity) AS v FROM lineitem GROUP BY 1)"
PRICE = "SELECT 'price' AS series_id, row_number() OVER (ORDER BY d) - 1 AS idx, v AS value FROM (SELECT o_orderdate AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1)"
HOURLY = "SELECT 'hourly' AS series_id, row_number() OVER (ORDER BY h) - 1 AS idx, v AS value FROM (SELECT date_trunc('hour', ts) AS h, sum(value) AS v FROM events GROUP BY 1)"
FLAGS = "SELECT l_returnflag AS series_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY d) - 1 AS idx, v AS value FROM (SELECT l_returnflag, l_shipdate AS d, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
USERS = "SELECT user_id::VARCHAR AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value FROM events"
TYPES = """SELECT dim, row_number() OVER (PARTITION BY dim ORDER BY h) - 1 AS idx, coalesce(v, 0) AS value
  FROM (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events) CROSS JOIN (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::INT AS dim FROM (SELECT DISTINCT event_type FROM events))
  LEFT JOIN (SELECT date_trunc('hour', ts) AS h, event_type, sum(value) AS v FROM events GROUP BY 1, 2) USING (h, event_type)"""


def windows_sql(series: str, m: int, by: str = "series_id") -> str:
    """Windows of a series: by, i, a, z, mu, sd, const."""
    return f"""SELECT {by}, i, a, mu, sd, lo = hi AS const, CASE WHEN lo = hi THEN list_transform(a, lambda x: 0.0::DOUBLE) ELSE list_transform(a, lambda x: (x - mu) / sd) END AS z
    FROM (SELECT {by}, idx AS i, list(value) OVER w AS a, avg(value) OVER w AS mu, stddev_pop(value) OVER w AS sd, min(value) OVER w AS lo, max(value) OVER w AS hi
          FROM ({series}) WINDOW w AS (PARTITION BY {by} ORDER BY idx ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING)) WHERE len(a) = {m}"""


def distance_sql(metric: Metric, m: int, x: str = "x", y: str = "y") -> str:
    # snapped as in the kernel; positions are chosen by rounded distances, or the summing order would decide between equals
    if metric.normalized:
        return f"CASE WHEN {x}.const AND {y}.const THEN 0 WHEN {x}.const OR {y}.const THEN sqrt({m}) WHEN list_distance({x}.z, {y}.z) < 1e-7 THEN 0 ELSE list_distance({x}.z, {y}.z) END"
    if metric.p == 2:
        return f"list_distance({x}.a, {y}.a)"
    return f"pow(list_sum(list_transform(list_zip({x}.a, {y}.a), lambda t: pow(abs(t[1] - t[2]), {metric.p}))), {1 / metric.p!r})"


def pairs_sql(series: str, m: int, metric: Metric, zone: int) -> str:
    return f"w AS ({windows_sql(series, m)}), pairs AS (SELECT x.series_id, x.i, y.i AS j, {distance_sql(metric, m)} AS d FROM w x JOIN w y ON x.series_id = y.series_id AND abs(x.i - y.i) > {zone})"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def profile_rows(p: DataFrame) -> DataFrame:
    """series_id, i, d, j, left_j, right_j; missing neighbours as in the reference output: -1."""
    p = P.nearest(p)
    c = lambda x: F.coalesce(x, F.lit(-1)).cast("long").alias(x)
    return p.select("series_id", "i", F.round("d", 6).alias("d"), c("j"), c("left_j"), c("right_j"))


def _self_sql(series: str, m: int, metric: Metric, zone: int) -> str:
    return f"""WITH {pairs_sql(series, m, metric, zone)}
SELECT w.series_id, w.i::BIGINT AS i, round(min(d), 6) AS d, coalesce(min(struct_pack(d := round(d, 9), j := j)).j, -1)::BIGINT AS j,
  coalesce((min(struct_pack(d := round(d, 9), j := j)) FILTER (j < w.i)).j, -1)::BIGINT AS left_j, coalesce((min(struct_pack(d := round(d, 9), j := j)) FILTER (j > w.i)).j, -1)::BIGINT AS right_j
FROM w LEFT JOIN pairs ON w.series_id = pairs.series_id AND w.i = pairs.i GROUP BY 1, 2"""


def _self(source, m: int, metric: Metric, **more):
    return lambda spark, sf: profile_rows(P.self_join(source(spark, sf), m, metric=metric, **more))


Z = Metric()
M, TM = 16, 12

QUERIES["self_join_znorm"] = _self(S.daily_quantity, M, Z)
ORACLES["self_join_znorm"] = _self_sql(QUANTITY, M, Z, 4)
QUERIES["self_join_znorm_sql"] = _self(S.hourly_events, 12, Z, strategy="sql")
ORACLES["self_join_znorm_sql"] = _self_sql(HOURLY, 12, Z, 3)
for _p in (1.0, 2.0, 3.0):
    QUERIES[f"self_join_minkowski_p{_p:g}"] = _self(S.hourly_events, 12, Metric(_p))
    ORACLES[f"self_join_minkowski_p{_p:g}"] = _self_sql(HOURLY, 12, Metric(_p), 3)
QUERIES["self_join_many_series"] = _self(S.user_events, 8, Z)
ORACLES["self_join_many_series"] = _self_sql(USERS, 8, Z, 2)


@query("rolling_stats", f"SELECT series_id, i::BIGINT AS i, round(mu, 6) AS mu, round(sd, 6) AS sd, list_min(a) AS low, list_max(a) AS high, true AS is_finite, const AS is_const FROM ({windows_sql(QUANTITY, M)})")
def rolling_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rolling(S.daily_quantity(spark, sf), M).withColumns({"mu": F.round("mu", 6), "sd": F.round("sd", 6)})


# One query window against a series

AT = 100


def _mass(metric: Metric):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = S.daily_quantity(spark, sf)
        return P.distance_profile(s, search.window_at(s, AT, M), metric, AT).select("series_id", "i", F.round("d", 6).alias("d"))

    return run


def _mass_sql(metric: Metric) -> str:
    return f"WITH w AS ({windows_sql(QUANTITY, M)}) SELECT y.series_id, y.i::BIGINT AS i, round(CASE WHEN y.i = {AT} THEN 0 ELSE {distance_sql(metric, M)} END, 6) AS d FROM w x JOIN w y ON x.i = {AT}"


for _name, _metric in (("mass_znorm", Z), ("mass_minkowski_p1", Metric(1.0)), ("mass_minkowski_p3", Metric(3.0))):
    QUERIES[_name], ORACLES[_name] = _mass(_metric), _mass_sql(_metric)


def _ab_sql(a: str, b: str, m: int, metric: Metric) -> str:
    """x, y windows of both, ab: distances."""
    return f"x AS ({windows_sql(a, m)}), y AS ({windows_sql(b, m)}), ab AS (SELECT x.series_id, y.series_id AS other_id, x.i, y.i AS j, {distance_sql(metric, m)} AS d FROM x, y)"


def _ab(metric: Metric):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        p = P.nearest(P.ab_join(S.daily_quantity(spark, sf), S.daily_price(spark, sf), M, metric=metric))
        return p.select("series_id", "other_id", "i", F.round("d", 2 if metric.p else 6).alias("d"), "j")

    return run


for _name, _metric in (("ab_join_znorm", Z), ("ab_join_minkowski", Metric(2.0))):
    QUERIES[_name] = _ab(_metric)
    ORACLES[_name] = f"WITH {_ab_sql(QUANTITY, PRICE, M, _metric)} SELECT series_id, other_id, i::BIGINT AS i, round(min(d), {2 if _metric.p else 6}) AS d, min(struct_pack(d := round(d, 9), j := j)).j::BIGINT AS j FROM ab GROUP BY ALL"


@query("topk_profile", f"""WITH {pairs_sql(HOURLY, 12, Z, 3)} SELECT series_id, i::BIGINT AS i, rank::INT AS rank, round(d, 6) AS d, j::BIGINT AS j
FROM (SELECT *, row_number() OVER (PARTITION BY series_id, i ORDER BY d, j) AS rank FROM pairs) WHERE rank <= 3""")
def topk_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.flat(P.self_join(S.hourly_events(spark, sf), 12, k=3)).withColumn("d", F.round("d", 6))


@query("discords_top1", f"""WITH {pairs_sql(QUANTITY, M, Z, 4)}, p AS (SELECT series_id, i, min(d) AS d FROM pairs GROUP BY ALL)
SELECT series_id, 1 AS rank, i::BIGINT AS i, round(d, 6) AS d FROM p ORDER BY p.d DESC, p.i LIMIT 1""")
def discords_top1(spark: SparkSession, sf: str) -> DataFrame:
    return P.discords(P.self_join(S.daily_quantity(spark, sf), M), M).withColumn("d", F.round("d", 6))


@query("distances_from_indices", f"""WITH {pairs_sql(HOURLY, 12, Z, 3)} SELECT series_id, i::BIGINT AS i, min(struct_pack(d := round(d, 9), j := j)).j::BIGINT AS j, round(min(d), 6) AS d FROM pairs GROUP BY ALL""")
def distances_from_indices(spark: SparkSession, sf: str) -> DataFrame:
    s = S.hourly_events(spark, sf)
    return P.from_indices(P.nearest(P.self_join(s, 12)), s, 12).withColumn("d", F.round("d", 6))


def _match_sql(metric: Metric, digits: int = 6) -> str:
    return f"""WITH RECURSIVE w AS ({windows_sql(QUANTITY, M)}), q AS (SELECT * FROM w WHERE i = {AT}),
prof AS (SELECT x.i, CASE WHEN x.i = {AT} THEN 0 ELSE {distance_sql(metric, M, 'x', 'q')} END AS d FROM w x, q),
bound AS (SELECT greatest(avg(d) - 2 * stddev_pop(d), min(d)) + 1e-8 AS b FROM prof),
picks(n, taken, d) AS (
  SELECT 1, [{AT}::BIGINT], 0.0::DOUBLE
  UNION ALL
  SELECT n + 1, list_append(taken, best.i), best.d FROM (
    SELECT p.n, any_value(p.taken) AS taken, min(struct_pack(d := prof.d, i := prof.i)) AS best FROM picks p, prof, bound
    WHERE p.n < 10 AND prof.d <= b AND len(list_filter(p.taken, lambda t: abs(t - prof.i) <= 4)) = 0 GROUP BY p.n))
SELECT 'quantity' AS series_id, n::INT AS rank, taken[n] AS i, round(d, {digits}) AS d FROM picks"""


def _match(metric: Metric):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = S.daily_quantity(spark, sf)
        return search.match(s, search.window_at(s, AT, M), max_matches=10, metric=metric, query_index=AT).withColumn("d", F.round("d", 6))

    return run


L2 = Metric(2.0)
for _name, _metric in (("match", Z), ("match_minkowski", L2)):
    QUERIES[_name], ORACLES[_name] = _match(_metric), _match_sql(_metric)


def _picks_sql(n: int, bound: str, metric: Metric = Z) -> str:
    """The greedy matches of candidate c<n>: its distance profile and the choices so far."""
    return f"""prof{n} AS (SELECT x.i, CASE WHEN x.i = q.i THEN 0 ELSE {distance_sql(metric, M, 'x', 'q')} END AS d FROM c{n} JOIN w q ON q.i = c{n}.i, w x),
picks{n}(n, taken, d) AS (
  SELECT 1, [i], 0.0::DOUBLE FROM c{n}
  UNION ALL
  SELECT n + 1, list_append(taken, best.i), best.d FROM (
    SELECT p.n, any_value(p.taken) AS taken, min(struct_pack(d := t.d, i := t.i)) AS best FROM picks{n} p, prof{n} t
    WHERE p.n < 10 AND t.d <= {bound} AND len(list_filter(p.taken, lambda g: abs(g - t.i) <= 4)) = 0 GROUP BY p.n)),
gone{n} AS (SELECT taken FROM picks{n} ORDER BY n DESC LIMIT 1)"""


def _motifs_sql(metric: Metric, most: float) -> str:
    return f"""WITH RECURSIVE {pairs_sql(QUANTITY, M, metric, 4)}, p AS (SELECT i, min(d) AS d FROM pairs GROUP BY i),
c1 AS (SELECT min(struct_pack(d := d, i := i)).i AS i FROM p), {_picks_sql(1, f"{most} + 1e-8", metric)},
c2 AS (SELECT min(struct_pack(d := d, i := i)).i AS i FROM p, gone1 WHERE len(list_filter(taken, lambda g: abs(g - p.i) <= 4)) = 0), {_picks_sql(2, f"{most} + 1e-8", metric)}
SELECT 0 AS motif, n::INT AS rank, taken[n] AS i, round(d, 6) AS d FROM picks1 UNION ALL SELECT 1, n::INT, taken[n], round(d, 6) FROM picks2"""


def _motifs(metric: Metric, most: float):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = S.daily_quantity(spark, sf)
        return search.motifs(s, P.self_join(s, M, metric=metric), M, max_motifs=2, cutoff=float("inf"), max_distance=most, metric=metric).withColumn("d", F.round("d", 6))

    return run


for _name, _metric, _most in (("motifs", Z, 4.0), ("motifs_minkowski", L2, 1e7)):
    QUERIES[_name], ORACLES[_name] = _motifs(_metric, _most), _motifs_sql(_metric, _most)


# Chains

_LINKS = f"""{pairs_sql(QUANTITY, M, Z, 4)},
p AS (SELECT w.i, (min(struct_pack(d := round(d, 9), j := j)) FILTER (j < w.i)).j AS l, (min(struct_pack(d := round(d, 9), j := j)) FILTER (j > w.i)).j AS r FROM w LEFT JOIN pairs USING (series_id, i) GROUP BY w.i),
links AS (SELECT a.i AS f, b.i AS t FROM p a JOIN p b ON a.r = b.i AND b.l = a.i),
chains(chain, pos, i) AS (SELECT i, 0, i FROM p WHERE i NOT IN (SELECT t FROM links) UNION ALL SELECT chain, pos + 1, t FROM chains JOIN links ON f = chains.i),
sizes AS (SELECT chain, count(*) AS length FROM chains GROUP BY chain)"""


@query("chains", f"""WITH RECURSIVE {_LINKS}
SELECT 'quantity' AS series_id, chain::BIGINT AS chain, pos::BIGINT AS pos, i::BIGINT AS i, length, chain = (SELECT min(struct_pack(n := -length, c := chain)).c FROM sizes) AS longest FROM chains JOIN sizes USING (chain)""")
def all_chains(spark: SparkSession, sf: str) -> DataFrame:
    return chains.all_chains(P.self_join(S.daily_quantity(spark, sf), M))


@query("anchored_chain", f"""WITH RECURSIVE {_LINKS}, own AS (SELECT chain, pos FROM chains WHERE i = {AT})
SELECT 'quantity' AS series_id, (c.pos - own.pos)::BIGINT AS pos, c.i::BIGINT AS i FROM chains c JOIN own ON c.chain = own.chain AND c.pos >= own.pos""")
def anchored_chain(spark: SparkSession, sf: str) -> DataFrame:
    return chains.anchored_chain(P.self_join(S.daily_quantity(spark, sf), M), AT)


@query("geometric_chains", f"""WITH RECURSIVE {pairs_sql(HOURLY, TM, Z, 3)}, p AS (SELECT i AS f, min(struct_pack(d := round(d, 9), j := j)).j AS t FROM pairs WHERE j < i GROUP BY i),
found(chain, pos, i) AS (
  SELECT f, 1, t FROM p
  UNION ALL
  SELECT g.chain, g.pos + 1, p.t FROM found g JOIN p ON g.i = p.f JOIN w c ON c.i = g.chain JOIN w a ON a.i = g.i JOIN w n ON n.i = p.t
  WHERE degrees(acos(greatest(-1, least(1, list_cosine_similarity(list_transform(list_zip(a.z, c.z), lambda t: t[1] - t[2]), list_transform(list_zip(n.z, c.z), lambda t: t[1] - t[2])))))) <= 40),
long AS (SELECT chain, max(pos) AS last FROM found GROUP BY chain HAVING max(pos) >= 2),
every AS (SELECT chain, 0 AS pos, chain AS i FROM long UNION ALL SELECT found.* FROM found JOIN long USING (chain)),
steps AS (SELECT a.chain, max(list_distance(x.z, y.z)) AS most FROM every a JOIN every b ON a.chain = b.chain AND b.pos = a.pos + 1 JOIN w x ON x.i = a.i JOIN w y ON y.i = b.i GROUP BY a.chain),
score AS (SELECT e.chain, list_distance(x.z, y.z) / most AS score FROM every e JOIN long ON e.chain = long.chain AND pos = last JOIN steps ON steps.chain = e.chain JOIN w x ON x.i = e.i JOIN w y ON y.i = e.chain)
SELECT 'hourly' AS series_id, chain::BIGINT AS chain, pos::INT AS pos, i::BIGINT AS i, round(score, 6) AS score FROM every JOIN score USING (chain)""")
def geometric_chains(spark: SparkSession, sf: str) -> DataFrame:
    s = S.hourly_events(spark, sf)
    return chains.geometric_chains(P.self_join(s, TM), s, TM).withColumn("score", F.round("score", 6))


# Segmentation

_CURVE = f"""{pairs_sql(QUANTITY, M, Z, 4)}, p AS (SELECT i, min(struct_pack(d := round(d, 9), j := j)).j AS j FROM pairs GROUP BY i),
steps AS (SELECT i, sum(s) AS s FROM (SELECT least(i, j) AS i, 1 AS s FROM p UNION ALL SELECT greatest(i, j), -1 FROM p) GROUP BY i),
curve AS (SELECT p.i, sum(coalesce(s, 0)) OVER (ORDER BY p.i) AS arcs, count(*) OVER () AS w FROM p LEFT JOIN steps USING (i)),
cac AS (SELECT i, arcs, CASE WHEN i < 80 OR i >= w - 80 THEN 1 ELSE least(1, arcs / (2.0 * (i + 1) * (w - 1 - i) / w)) END AS cac FROM curve)"""


@query("fluss_curve", f"WITH {_CURVE} SELECT 'quantity' AS series_id, i::BIGINT AS i, arcs::BIGINT AS arcs, round(cac, 6) AS cac FROM cac")
def fluss_curve(spark: SparkSession, sf: str) -> DataFrame:
    return segment.arc_curve(P.nearest(P.self_join(S.daily_quantity(spark, sf), M)), M).withColumn("cac", F.round("cac", 6))


@query("fluss_regimes", f"""WITH {_CURVE}, a AS (SELECT min(struct_pack(c := cac, i := i)).i AS i FROM cac),
b AS (SELECT min(struct_pack(c := CASE WHEN cac.i >= a.i - 80 AND cac.i < a.i + 80 THEN 1 ELSE cac END, i := cac.i)).i AS i FROM cac, a)
SELECT 'quantity' AS series_id, 1 AS regime, i::BIGINT AS i FROM a UNION ALL SELECT 'quantity', 2, i::BIGINT FROM b""")
def fluss_regimes(spark: SparkSession, sf: str) -> DataFrame:
    curve = segment.arc_curve(P.nearest(P.self_join(S.daily_quantity(spark, sf), M)), M)
    return segment.regimes(curve, M, 3)


# Sets of series: hourly sums by event type, as five series

TYPE_SERIES = f"SELECT dim::VARCHAR AS series_id, idx, value FROM ({TYPES})"


def types_as_series(spark: SparkSession, sf: str) -> DataFrame:
    return S.hourly_events_by_type(spark, sf).select(F.col("dim").cast("string").alias("series_id"), "idx", "value")


def _ostinato_sql(metric: Metric) -> str:
    return f"""WITH w AS ({windows_sql(TYPE_SERIES, TM)}), near AS (SELECT x.series_id, x.i, y.series_id AS o, min({distance_sql(metric, TM)}) AS d FROM w x JOIN w y ON x.series_id <> y.series_id GROUP BY ALL),
r AS (SELECT series_id, i, max(d) AS radius, sum(d) / 5 AS mean FROM near GROUP BY ALL), tied AS (SELECT * FROM r WHERE radius <= (SELECT min(radius) * (1 + 1e-5) + 1e-8 FROM r))
SELECT series_id, i::BIGINT AS i, round(radius, 6) AS radius, round(mean, 6) AS mean FROM tied ORDER BY tied.mean, series_id, tied.i LIMIT 1"""


def _ostinato(metric: Metric, **how):
    return lambda spark, sf: compare.consensus(types_as_series(spark, sf), TM, metric=metric, **how).withColumns({"radius": F.round("radius", 6), "mean": F.round("mean", 6)})


for _name, _metric in (("ostinato", Z), ("ostinato_minkowski", L2)):
    QUERIES[_name], ORACLES[_name] = _ostinato(_metric), _ostinato_sql(_metric)


def _mpdist_sql(a: str, b: str, m: int, metric: Metric, condition: str = "true", digits: int = 6) -> str:
    return f"""WITH x AS ({windows_sql(a, m)}), y AS ({windows_sql(b, m)}), ab AS (SELECT x.series_id AS s, y.series_id AS o, x.i, y.i AS j, {distance_sql(metric, m)} AS d FROM x JOIN y ON {condition}),
best AS (SELECT s, o, min(d) AS d FROM ab GROUP BY s, o, i UNION ALL SELECT s, o, min(d) FROM ab GROUP BY s, o, j),
n AS (SELECT s, o, na + nb AS n FROM (SELECT series_id AS s, count(*) + {m - 1} AS na FROM x GROUP BY 1), (SELECT series_id AS o, count(*) + {m - 1} AS nb FROM y GROUP BY 1)),
ranked AS (SELECT s, o, d, row_number() OVER (PARTITION BY s, o ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY s, o) AS c FROM best)
SELECT s AS series_id, o AS other_id, round(d, {digits}) AS mpdist FROM ranked JOIN n USING (s, o) WHERE r = least(ceil(0.05 * n), c - 1)"""


@query("mpdist", _mpdist_sql(QUANTITY, PRICE, M, Z))
def mpdist(spark: SparkSession, sf: str) -> DataFrame:
    return compare.mpdist(S.daily_quantity(spark, sf), S.daily_price(spark, sf), M).withColumn("mpdist", F.round("mpdist", 6))


@query("mpdist_minkowski", _mpdist_sql(QUANTITY, PRICE, M, Metric(2.0), digits=2))
def mpdist_minkowski(spark: SparkSession, sf: str) -> DataFrame:
    return compare.mpdist(S.daily_quantity(spark, sf), S.daily_price(spark, sf), M, metric=Metric(2.0)).withColumn("mpdist", F.round("mpdist", 2))


@query("mpdist_matrix", _mpdist_sql(TYPE_SERIES, TYPE_SERIES, TM, Z, "x.series_id < y.series_id"))
def mpdist_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return compare.mpdist_matrix(types_as_series(spark, sf), TM).withColumn("mpdist", F.round("mpdist", 6))


@query("shapelet_diff", f"""WITH {pairs_sql(QUANTITY, M, Z, 4)}, x AS (SELECT * FROM w), y AS ({windows_sql(PRICE, M)}),
ab AS (SELECT x.i, min({distance_sql(Z, M)}) AS d FROM x, y GROUP BY x.i), own AS (SELECT i, min(d) AS d FROM pairs GROUP BY i)
SELECT 'quantity' AS series_id, ab.i::BIGINT AS i, round(ab.d - own.d, 6) AS diff FROM ab JOIN own USING (i) ORDER BY ab.d - own.d DESC, ab.i LIMIT 10""")
def shapelet_diff(spark: SparkSession, sf: str) -> DataFrame:
    return compare.shapelets(S.daily_quantity(spark, sf), S.daily_price(spark, sf), M).withColumn("diff", F.round("diff", 6))


@query("shapelet_features", f"""WITH w AS ({windows_sql(USERS, 8)}), q AS (SELECT row_number() OVER (ORDER BY i) - 1 AS shapelet, z, const FROM w WHERE series_id = '1' AND i IN (0, 20))
SELECT w.series_id, shapelet::INT AS shapelet, round(min({distance_sql(Z, 8, 'w', 'q')}), 6) AS d FROM w, q GROUP BY ALL""")
def shapelet_features(spark: SparkSession, sf: str) -> DataFrame:
    s = S.user_events(spark, sf)
    own = s.where("series_id = '1'")
    return compare.shapelet_features(s, [search.window_at(own, 0, 8), search.window_at(own, 20, 8)]).withColumn("d", F.round("d", 6))


@query("steadiness_annotation", f"WITH w AS ({windows_sql(QUANTITY, M)}) SELECT 'quantity' AS series_id, i::BIGINT AS i, CASE WHEN sd * sd * {M} / {M - 1} < 40000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS av FROM w")
def steadiness_annotation(spark: SparkSession, sf: str) -> DataFrame:
    return compare.steadiness(S.daily_quantity(spark, sf), M, 40000.0)


@query("unclipped_annotation", f"""WITH s AS ({QUANTITY}), e AS (SELECT min(value) AS low, max(value) AS high FROM s), c AS (SELECT i, len(list_filter(a, lambda x: x = low)) + len(list_filter(a, lambda x: x = high)) AS c FROM ({windows_sql(QUANTITY, M)}), e)
SELECT 'quantity' AS series_id, i::BIGINT AS i, round(1 - coalesce((c - min(c) OVER ()) / nullif(max(c) OVER (), 0), 0), 6) AS av FROM c""")
def unclipped_annotation(spark: SparkSession, sf: str) -> DataFrame:
    return compare.unclipped(S.daily_quantity(spark, sf), M).withColumn("av", F.round("av", 6))


_COMPLEXITY = f"""ce AS (SELECT i, sqrt(list_sum(list_transform(range(1, {M}), lambda k: pow(a[k + 1] - a[k], 2)))) AS ce FROM w),
av AS (SELECT i, coalesce((ce - min(ce) OVER ()) / nullif(max(ce) OVER () - min(ce) OVER (), 0), 0) AS av FROM ce)"""


@query("complexity_annotation", f"WITH w AS ({windows_sql(QUANTITY, M)}), {_COMPLEXITY} SELECT 'quantity' AS series_id, i::BIGINT AS i, round(av, 6) AS av FROM av")
def complexity_annotation(spark: SparkSession, sf: str) -> DataFrame:
    return compare.complexity(S.daily_quantity(spark, sf), M).withColumn("av", F.round("av", 6))


@query("annotated_profile", f"""WITH {pairs_sql(QUANTITY, M, Z, 4)}, {_COMPLEXITY}, p AS (SELECT i, min(d) AS d FROM pairs GROUP BY i)
SELECT 'quantity' AS series_id, i::BIGINT AS i, round(d + (1 - av) * max(d) OVER (), 6) AS d FROM p JOIN av USING (i)""")
def annotated_profile(spark: SparkSession, sf: str) -> DataFrame:
    s = S.daily_quantity(spark, sf)
    return compare.annotate(P.nearest(P.self_join(s, M)).select("series_id", "i", "d"), compare.complexity(s, M)).withColumn("d", F.round("d", 6))


@query("swap_scores", f"""WITH heads AS (SELECT series_id, idx, value FROM ({TYPE_SERIES}) WHERE idx < 300), tails AS (SELECT series_id, idx - 300 AS idx, value FROM ({TYPE_SERIES}) WHERE idx >= 300),
x AS ({windows_sql("SELECT * FROM heads", TM)}), y AS ({windows_sql("SELECT * FROM tails", TM)}),
least AS (SELECT x.series_id AS s, y.series_id AS o, min({distance_sql(Z, TM)}) AS d FROM x, y GROUP BY ALL)
SELECT a.s AS series_id, a.o AS other_id, round(a.d / (b.d + 1e-9), 6) AS score FROM least a JOIN least b ON a.s = b.s AND b.s = b.o WHERE a.s <> a.o""")
def swap_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = types_as_series(spark, sf)
    heads, tails = s.where("idx < 300"), s.where("idx >= 300").withColumn("idx", F.col("idx") - 300)
    return compare.swap_scores(heads, tails, TM).withColumn("score", F.round("score", 6))


@query("uniform_scaling", f"""WITH n AS (SELECT count(*) AS n FROM ({PRICE})), scaled AS (SELECT s AS scale, g.idx AS idx, p.value FROM (SELECT s, unnest(range(0, ceil(n * s / 100)::BIGINT)) AS idx FROM n, (SELECT unnest([90, 100, 110]) AS s)) g JOIN ({PRICE}) p ON p.idx = floor(g.idx * 100 / s)),
x AS ({windows_sql(QUANTITY, M)}), y AS ({windows_sql("SELECT scale AS series_id, idx, value FROM scaled", M)}),
ab AS (SELECT x.i, min(struct_pack(d := {distance_sql(Z, M)}, scale := y.series_id, j := y.i)) AS b FROM x, y GROUP BY x.i)
SELECT 'quantity' AS series_id, 'price' AS other_id, i::BIGINT AS i, b.scale::INT AS scale, round(b.d, 6) AS d, b.j::BIGINT AS j FROM ab""")
def uniform_scaling(spark: SparkSession, sf: str) -> DataFrame:
    return compare.uniform_scaling(S.daily_quantity(spark, sf), S.daily_price(spark, sf), M, [90, 100, 110]).withColumn("d", F.round("d", 6))


# Several dimensions: hourly sums by event type

_DIMS_W = f"w AS ({windows_sql(TYPES, TM, 'dim')})"


def _dims_pairs(metric: Metric, condition: str) -> str:
    """The k-dimensional distance of every pair of windows."""
    return f"""{_DIMS_W}, each AS (SELECT x.i, y.i AS j, x.dim, {distance_sql(metric, TM)} AS d FROM w x JOIN w y ON x.dim = y.dim AND {condition}),
multi AS (SELECT i, j, (row_number() OVER o - 1)::INT AS kdim, avg(d) OVER (PARTITION BY i, j ORDER BY d, dim ROWS UNBOUNDED PRECEDING) AS d FROM each WINDOW o AS (PARTITION BY i, j ORDER BY d, dim))"""


def _best_multi(metric: Metric, digits: int) -> str:
    return f"WITH {_dims_pairs(metric, 'abs(x.i - y.i) > 3')} SELECT 'events' AS series_id, i::BIGINT AS i, kdim, round(min(d), {digits}) AS d, min(struct_pack(d := round(d, 9), j := j)).j::BIGINT AS j FROM multi GROUP BY i, kdim"


def _multi(metric: Metric, digits: int):
    return lambda spark, sf: multidim.multi_profile(S.hourly_events_by_type(spark, sf), TM, metric=metric).withColumn("d", F.round("d", digits))


QUERIES["multi_profile"], ORACLES["multi_profile"] = _multi(Z, 6), _best_multi(Z, 6)
QUERIES["multi_profile_minkowski"], ORACLES["multi_profile_minkowski"] = _multi(Metric(2.0), 4), _best_multi(Metric(2.0), 4)


def _multi_distances(metric: Metric):
    return lambda spark, sf: multidim.distance_profiles(S.hourly_events_by_type(spark, sf), TM, AT, metric=metric).withColumn("d", F.round("d", 6))


for _name, _metric in (("multi_distance_profile", Z), ("multi_distance_profile_minkowski", L2)):
    QUERIES[_name] = _multi_distances(_metric)
    ORACLES[_name] = f"WITH {_dims_pairs(_metric, f'x.i = {AT}')} SELECT 'events' AS series_id, j::BIGINT AS i, kdim, round(CASE WHEN j = {AT} THEN 0 ELSE d END, 6) AS d FROM multi"


# The windows at AT and OTHER of each dimension, as eight-bit steps of the normal distribution
OTHER = 200
_EDGES = "[" + ", ".join(repr(NormalDist().inv_cdf(q / 256)) for q in range(1, 256)) + "]"
_CODES = f"""{_DIMS_W}, codes AS (SELECT x.dim, list_transform(x.z, lambda v: len(list_filter({_EDGES}, lambda e: e < v))) AS a, list_transform(y.z, lambda v: len(list_filter({_EDGES}, lambda e: e < v))) AS b
  FROM w x JOIN w y ON x.dim = y.dim AND x.i = {AT} AND y.i = {OTHER}),
ranked AS (SELECT dim, list_transform(list_zip(a, b), lambda t: t[1] - t[2]) AS diff, row_number() OVER (ORDER BY sqrt(list_sum(list_transform(list_zip(a, b), lambda t: pow(t[1] - t[2], 2)))), dim) AS r FROM codes)"""


@query("description_lengths", f"""WITH {_CODES}, sizes AS (SELECT k, (SELECT count(*) FROM codes) AS dims FROM (SELECT unnest(range(0, 5)) AS k)),
vals AS (SELECT k, count(DISTINCT v) AS n, list(DISTINCT dim ORDER BY dim) AS subspace FROM (SELECT k, dim, unnest(diff) AS v FROM ranked JOIN sizes ON r <= k + 1) GROUP BY k)
SELECT k::INT AS kdim, round(8.0 * (2 * dims * {TM} - (k + 1) * {TM}) + (k + 1) * {TM} * log2(n) + n * 8, 6) AS bits, array_to_string(subspace, ',') AS subspace FROM sizes JOIN vals USING (k)""")
def description_lengths(spark: SparkSession, sf: str) -> DataFrame:
    d = multidim.description_lengths(S.hourly_events_by_type(spark, sf), TM, [AT] * 5, [OTHER] * 5)
    return d.select("kdim", F.round("bits", 6).alias("bits"), F.array_join(F.array_sort("subspace").cast("array<string>"), ",").alias("subspace"))


@query("subspace", f"WITH {_CODES} SELECT r::INT - 1 AS place, dim::INT AS dim FROM ranked WHERE r <= 3")
def subspace(spark: SparkSession, sf: str) -> DataFrame:
    return multidim.subspace(S.hourly_events_by_type(spark, sf), TM, AT, OTHER, 2)


# of raw values: 256 even steps of the range of all values, halves to the even step
_LINEAR = f"""{_DIMS_W}, span AS (SELECT min(value) AS low, max(value) AS high FROM ({TYPES})),
codes AS (SELECT x.dim, list_transform(x.a, lambda v: round_even((v - low) / (high - low) * 255, 0)) AS a, list_transform(y.a, lambda v: round_even((v - low) / (high - low) * 255, 0)) AS b
  FROM w x JOIN w y ON x.dim = y.dim AND x.i = {AT} AND y.i = {OTHER}, span),
ranked AS (SELECT dim, list_transform(list_zip(a, b), lambda t: t[1] - t[2]) AS diff, row_number() OVER (ORDER BY sqrt(list_sum(list_transform(list_zip(a, b), lambda t: pow(t[1] - t[2], 2)))), dim) AS r FROM codes)"""


@query("description_lengths_minkowski", ORACLES["description_lengths"].replace(_CODES, _LINEAR))
def description_lengths_minkowski(spark: SparkSession, sf: str) -> DataFrame:
    d = multidim.description_lengths(S.hourly_events_by_type(spark, sf), TM, [AT] * 5, [OTHER] * 5, metric=L2)
    return d.select("kdim", F.round("bits", 6).alias("bits"), F.array_join(F.array_sort("subspace").cast("array<string>"), ",").alias("subspace"))


@query("subspace_minkowski", f"WITH {_LINEAR} SELECT r::INT - 1 AS place, dim::INT AS dim FROM ranked WHERE r <= 3")
def subspace_minkowski(spark: SparkSession, sf: str) -> DataFrame:
    return multidim.subspace(S.hourly_events_by_type(spark, sf), TM, AT, OTHER, 2, metric=L2)


@query("multi_motifs")
def multi_motifs(spark: SparkSession, sf: str) -> DataFrame:
    s = S.hourly_events_by_type(spark, sf)
    found = multidim.multi_motifs(s, multidim.multi_profile(s, TM), TM, cutoffs=float("inf"), max_motifs=2)
    return found.withColumns({"d": F.round("d", 6), "bits": F.round("bits", 6), "subspace": F.array_join(F.col("subspace").cast("array<string>"), ",")})


@query("multi_motifs_two_dims", f"""WITH RECURSIVE {_dims_pairs(Z, 'abs(x.i - y.i) > 3')}, p AS (SELECT i, min(struct_pack(q := round(d, 9), j := j, d := d)) AS n FROM multi WHERE kdim = 1 GROUP BY i),
top AS (SELECT min(struct_pack(d := n.d, i := i, j := n.j)) AS t FROM p), pair AS (SELECT t.i AS i, t.j AS j FROM top),
codes AS (SELECT x.dim, list_transform(x.z, lambda v: len(list_filter({_EDGES}, lambda e: e < v))) AS a, list_transform(y.z, lambda v: len(list_filter({_EDGES}, lambda e: e < v))) AS b
  FROM pair JOIN w x ON x.i = pair.i JOIN w y ON y.i = pair.j AND y.dim = x.dim),
ranked AS (SELECT dim, list_transform(list_zip(a, b), lambda t: t[1] - t[2]) AS diff, row_number() OVER (ORDER BY sqrt(list_sum(list_transform(list_zip(a, b), lambda t: pow(t[1] - t[2], 2)))), dim) AS r FROM codes),
size AS (SELECT 8.0 * (2 * 5 * {TM} - 2 * {TM}) + 2 * {TM} * log2(count(DISTINCT v)) + count(DISTINCT v) * 8 AS bits FROM (SELECT unnest(diff) AS v FROM ranked WHERE r <= 2)),
prof AS MATERIALIZED (SELECT y.i, CASE WHEN y.i = pair.i THEN 0 ELSE avg({distance_sql(Z, TM)}) END AS d FROM pair JOIN w x ON x.i = pair.i JOIN ranked ON ranked.dim = x.dim AND r <= 2 JOIN w y ON y.dim = x.dim GROUP BY y.i, pair.i),
picks(n, taken, d) AS (
  SELECT 1, [i], 0.0::DOUBLE FROM pair
  UNION ALL
  SELECT n + 1, list_append(taken, best.i), best.d FROM (
    SELECT q.n, any_value(q.taken) AS taken, min(struct_pack(d := prof.d, i := prof.i)) AS best FROM picks q, prof WHERE q.n < 5 AND prof.d <= 3.5 + 1e-8 AND len(list_filter(q.taken, lambda t: abs(t - prof.i) <= 3)) = 0 GROUP BY q.n))
SELECT 0 AS motif, n::INT AS rank, taken[n]::BIGINT AS i, round(d, 6) AS d, 1 AS kdim, (SELECT string_agg(dim::VARCHAR, ',' ORDER BY r) FROM ranked WHERE r <= 2) AS subspace, (SELECT round(bits, 6) FROM size) AS bits FROM picks""")
def multi_motifs_two_dims(spark: SparkSession, sf: str) -> DataFrame:
    s = S.hourly_events_by_type(spark, sf)
    found = multidim.multi_motifs(s, multidim.multi_profile(s, TM), TM, max_distance=3.5, cutoffs=float("inf"), max_matches=5, k=1)
    return found.withColumns({"d": F.round("d", 6), "bits": F.round("bits", 6), "subspace": F.array_join(F.col("subspace").cast("array<string>"), ",")})


# Snippets, pan profiles, approximations


def _snippet_sql(metric: Metric) -> str:
    """With the sub-window as long as the window, MPdist is the distance itself."""
    return f"""w AS ({windows_sql(HOURLY, 48)}), every AS MATERIALIZED (SELECT (x.i // 48) AS chunk, y.i, {distance_sql(metric, 48)} AS d FROM w x JOIN w y ON x.i % 48 = 0), {_CHOICE}"""


_CHOICE = """a1 AS (SELECT chunk, sum(d) AS area FROM every GROUP BY chunk ORDER BY area, chunk LIMIT 1), cur AS (SELECT i, d FROM every JOIN a1 USING (chunk)),
a2 AS (SELECT chunk, sum(least(every.d, cur.d)) AS area FROM every JOIN cur USING (i) GROUP BY chunk ORDER BY 2, 1 LIMIT 1),
own AS (SELECT i, min(struct_pack(d := d, s := s)).s AS s FROM (SELECT i, d, 0 AS s FROM cur UNION ALL SELECT i, d, 1 FROM every JOIN a2 USING (chunk)) GROUP BY i)"""
# sub-windows of half the length: of 2 x 25 nearest distances the one at ceil(5 % of 96)
_HALVES = f"""w AS ({windows_sql(HOURLY, 24)}), d AS MATERIALIZED (SELECT x.i // 48 AS chunk, x.i % 48 AS k, y.i AS j, {distance_sql(Z, 24)} AS d FROM w x JOIN w y ON x.i % 48 <= 24 AND x.i // 48 < (SELECT count(*) + 23 FROM w) // 48),
rows AS (SELECT chunk, k, j AS i, min(d) OVER (PARTITION BY chunk, k ORDER BY j ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS d FROM d),
least AS (SELECT chunk, j, min(d) AS d FROM d GROUP BY chunk, j),
cols AS (SELECT a.chunk, a.j AS i, b.d FROM least a JOIN least b ON a.chunk = b.chunk AND b.j BETWEEN a.j AND a.j + 24),
each AS (SELECT chunk, i, d FROM rows WHERE i + 24 <= (SELECT max(j) FROM d) UNION ALL SELECT chunk, i, d FROM cols WHERE i + 24 <= (SELECT max(j) FROM d)),
every AS MATERIALIZED (SELECT chunk, i, list_sort(list(d))[6] AS d FROM each GROUP BY chunk, i), {_CHOICE}"""


def _snippet_table(sql: str) -> str:
    return f"""WITH {sql} SELECT 'hourly' AS series_id, s AS snippet, (chunk * 48)::BIGINT AS i, round(area, 5) AS area, round((SELECT count(*) FROM own WHERE own.s = a.s) / (SELECT count(*) FROM own), 6) AS fraction
FROM (SELECT 0 AS s, * FROM a1 UNION ALL SELECT 1, * FROM a2) a"""


def _snippets(s: int | None, metric: Metric):
    return lambda spark, sf: snippets.snippets(S.hourly_events(spark, sf), 48, 2, s=s, metric=metric)[0].withColumns({"area": F.round("area", 5), "fraction": F.round("fraction", 6)})


for _name, _size, _metric, _text in (("snippets", None, Z, _snippet_sql(Z)), ("snippets_minkowski", None, L2, _snippet_sql(L2)), ("snippets_of_halves", 24, Z, _HALVES)):
    QUERIES[_name], ORACLES[_name] = _snippets(_size, _metric), _snippet_table(_text)


@query("snippet_regimes", f"""WITH {_snippet_sql(Z)}, islands AS (SELECT i, s, i - row_number() OVER (PARTITION BY s ORDER BY i) AS g FROM own)
SELECT 'hourly' AS series_id, s AS snippet, min(i)::BIGINT AS start, (max(i) + 1)::BIGINT AS stop FROM islands GROUP BY s, g""")
def snippet_regimes(spark: SparkSession, sf: str) -> DataFrame:
    return snippets.snippets(S.hourly_events(spark, sf), 48, 2)[2]


PAN = (12, 20, 4)


def _pan_sql(metric: Metric = Z) -> str:
    parts = []
    for turn, m in enumerate(pan.window_sizes(10_000, *PAN)):
        parts.append(f"SELECT {m} AS m, {turn} AS turn, x.i, min({distance_sql(metric, m)}) AS d FROM ({windows_sql(HOURLY, m)}) x JOIN ({windows_sql(HOURLY, m)}) y ON abs(x.i - y.i) > {-(-m // 4)} GROUP BY x.i")
    return "pan AS (" + " UNION ALL ".join(parts) + ")"


for _name, _metric in (("pan_profile", Z), ("pan_profile_minkowski", L2)):
    QUERIES[_name] = lambda spark, sf, metric=_metric: pan.pan_profile(S.hourly_events(spark, sf), *PAN, metric=metric).withColumn("d", F.round("d", 6))
    ORACLES[_name] = f"WITH {_pan_sql(_metric)} SELECT 'hourly' AS series_id, m::INT AS m, turn::INT AS turn, i::BIGINT AS i, round(d, 6) AS d FROM pan"


@query("pan_contrast", f"""WITH {_pan_sql()}, scaled AS (SELECT m, i, least(1, d / (2 * sqrt(m))) AS d FROM pan),
shown AS (SELECT m, i, 1 / (1 + exp(-10 * ((row_number() OVER (ORDER BY d, m, i) - 1) / (count(*) OVER () - 1) - 0.2))) AS v FROM scaled),
grid AS (SELECT m, i FROM (SELECT DISTINCT m FROM pan), (SELECT unnest(range(0, (SELECT count(*) FROM ({HOURLY})))) AS i))
SELECT 'hourly' AS series_id, m::INT AS m, i::BIGINT AS i, round(coalesce(v, (SELECT max(v) FROM shown)), 6) AS value FROM grid LEFT JOIN shown USING (m, i)""")
def pan_contrast(spark: SparkSession, sf: str) -> DataFrame:
    s = S.hourly_events(spark, sf)
    n = s.count()
    return pan.pan_matrix(pan.pan_profile(s, *PAN), pan.window_sizes(n, *PAN), n, binary=False).withColumn("value", F.round("value", 6))


def _flat_rows(p: DataFrame) -> DataFrame:
    return P.nearest(p).select("series_id", "i", F.round("d", 6).alias("d"), F.coalesce("j", F.lit(-1)).cast("long").alias("j"))


_NEAREST = "SELECT series_id, i::BIGINT AS i, round(min(d), 6) AS d, min(struct_pack(d := round(d, 9), j := j)).j::BIGINT AS j"


def _exact_sql(metric: Metric) -> str:
    return f"WITH {pairs_sql(HOURLY, 12, metric, 3)} {_NEAREST} FROM pairs GROUP BY ALL"


for _name, _metric in (("sampled_profile_all", Z), ("sampled_profile_all_minkowski", L2)):
    QUERIES[_name] = lambda spark, sf, metric=_metric: _flat_rows(approximate.sampled_profile(S.hourly_events(spark, sf), 12, 0.1, updates=10, metric=metric))
    ORACLES[_name] = _exact_sql(_metric)


def _mixed_sql(x: str) -> str:
    """The diagonal's hash in 128-bit arithmetic mod 2^64, and its part of ten."""
    m = "18446744073709551616::UHUGEINT"
    a = f"(({x})::UHUGEINT + 11400714819323198485::UHUGEINT) % {m}"
    b = f"(xor({a}, ({a}) >> 30) * 13787848793156543929::UHUGEINT) % {m}"
    c = f"(xor({b}, ({b}) >> 27) * 10723151780598845931::UHUGEINT) % {m}"
    return f"xor({c}, ({c}) >> 31) % 10"


def _sampled_sql(metric: Metric) -> str:
    return f"""WITH {pairs_sql(HOURLY, 12, metric, 3)}, gaps AS (SELECT g FROM (SELECT unnest(range(1, (SELECT max(i) + 1 FROM w))) AS g) WHERE {_mixed_sql("g")} < 1),
best AS (SELECT pairs.series_id, i, min(d) AS d, min(struct_pack(d := round(d, 9), j := j)).j AS j FROM pairs JOIN gaps ON abs(i - j) = g GROUP BY ALL)
SELECT w.series_id, w.i::BIGINT AS i, round(d, 6) AS d, coalesce(j, -1)::BIGINT AS j FROM w LEFT JOIN best USING (series_id, i)"""


for _name, _metric in (("sampled_profile", Z), ("sampled_profile_minkowski", L2)):
    QUERIES[_name] = lambda spark, sf, metric=_metric: _flat_rows(approximate.sampled_profile(S.hourly_events(spark, sf), 12, 0.1, metric=metric))
    ORACLES[_name] = _sampled_sql(_metric)


def _extended_sql(metric: Metric) -> str:
    return f"""WITH {pairs_sql(HOURLY, 12, metric, 3)}, seeds AS (SELECT i, min(struct_pack(d := round(d, 9), j := j)).j AS j FROM pairs WHERE i % 3 = 0 GROUP BY i),
moved AS (SELECT i + g AS i, j + g AS j FROM seeds, (SELECT unnest([-2, -1, 1, 2]) AS g)),
offered AS (SELECT pairs.i, pairs.j, d FROM pairs WHERE i % 3 = 0 OR j % 3 = 0 UNION ALL SELECT pairs.i, pairs.j, d FROM pairs JOIN moved ON (pairs.i = moved.i AND pairs.j = moved.j) OR (pairs.i = moved.j AND pairs.j = moved.i))
SELECT 'hourly' AS series_id, i::BIGINT AS i, round(min(d), 6) AS d, min(struct_pack(d := round(d, 9), j := j)).j::BIGINT AS j FROM offered GROUP BY i"""


for _name, _metric in (("extended_profile", Z), ("extended_profile_minkowski", L2)):
    QUERIES[_name] = lambda spark, sf, metric=_metric: _flat_rows(approximate.extended_profile(S.hourly_events(spark, sf), 12, metric=metric))
    ORACLES[_name] = _extended_sql(_metric)


@query("extended_profile_ab", f"""WITH {_ab_sql(QUANTITY, PRICE, M, Z)}, seeds AS (SELECT i, min(struct_pack(d := round(d, 9), j := j)).j AS j FROM ab WHERE i % 4 = 0 GROUP BY i),
moved AS (SELECT i + g AS i, j + g AS j FROM seeds, (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS g)),
offered AS (SELECT series_id, i, j, d FROM ab WHERE i % 4 = 0 UNION ALL SELECT series_id, ab.i, ab.j, d FROM ab JOIN moved ON ab.i = moved.i AND ab.j = moved.j),
best AS (SELECT i, min(d) AS d, min(struct_pack(d := round(d, 9), j := j)).j AS j FROM offered GROUP BY i)
SELECT 'quantity' AS series_id, x.i::BIGINT AS i, round(d, 6) AS d, coalesce(j, -1)::BIGINT AS j FROM x LEFT JOIN best USING (i)""")
def extended_profile_ab(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_rows(approximate.extended_profile(S.daily_quantity(spark, sf), M, other=S.daily_price(spark, sf)))


@query("anytime_profile_all", _exact_sql(Z))
def anytime_profile_all(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_rows(approximate.anytime_profile(S.hourly_events(spark, sf), 12, 0.25, updates=4))


# Missing values, given constant flags, and what else the tables above don't hold

HOLES = f"SELECT series_id, idx, CASE WHEN idx % 37 = 5 THEN NULL ELSE value END AS value FROM ({HOURLY})"


def hourly_with_holes(spark: SparkSession, sf: str) -> DataFrame:
    hole = F.when(F.col("idx") % 74 == 5, F.lit(None)).when(F.col("idx") % 37 == 5, float("nan"))
    return S.hourly_events(spark, sf).withColumn("value", F.when(F.col("idx") % 37 == 5, hole).otherwise(F.col("value")))


def _holes_sql(metric: Metric) -> str:
    return f"""WITH every AS MATERIALIZED ({windows_sql(HOLES, 12)}), w AS MATERIALIZED (SELECT * FROM every WHERE len(list_filter(a, lambda v: v IS NULL)) = 0),
pairs AS (SELECT x.series_id, x.i, y.i AS j, {distance_sql(metric, 12)} AS d FROM w x JOIN w y ON abs(x.i - y.i) > 3)
SELECT every.series_id, every.i::BIGINT AS i, round(min(d), 6) AS d, coalesce(min(struct_pack(d := round(d, 9), j := j)).j, -1)::BIGINT AS j,
  coalesce((min(struct_pack(d := round(d, 9), j := j)) FILTER (j < every.i)).j, -1)::BIGINT AS left_j, coalesce((min(struct_pack(d := round(d, 9), j := j)) FILTER (j > every.i)).j, -1)::BIGINT AS right_j
FROM every LEFT JOIN pairs ON every.i = pairs.i GROUP BY 1, 2"""


for _name, _metric in (("self_join_missing", Z), ("self_join_missing_minkowski", L2)):
    QUERIES[_name], ORACLES[_name] = _self(hourly_with_holes, 12, _metric), _holes_sql(_metric)


@query("rolling_missing", f"SELECT series_id, i::BIGINT AS i, round(mu, 6) AS mu, round(sd, 6) AS sd, lo AS low, hi AS high, n::BIGINT AS n FROM (SELECT series_id, idx AS i, avg(value) OVER w AS mu, stddev_pop(value) OVER w AS sd, min(value) OVER w AS lo, max(value) OVER w AS hi, count(value) OVER w AS n, count(*) OVER w AS c FROM ({HOLES}) WINDOW w AS (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) WHERE c = 12")
def rolling_missing(spark: SparkSession, sf: str) -> DataFrame:
    return rolling_present(hourly_with_holes(spark, sf), 12).withColumns({"mu": F.round("mu", 6), "sd": F.round("sd", 6), "n": F.col("n").cast("long")})


@query("sliding_dot", f"SELECT series_id, i::BIGINT AS i, round(list_sum(list_transform(list_zip(a, [1.0, -2.0, 0.5, 3.0]), lambda t: t[1] * t[2])), 4) AS qt FROM ({windows_sql(QUANTITY, 4)})")
def sliding_dots(spark: SparkSession, sf: str) -> DataFrame:
    return sliding_dot(S.daily_quantity(spark, sf), [1.0, -2.0, 0.5, 3.0]).withColumn("qt", F.round("qt", 4))


#: Every fifth window counts as constant, no other does.
_FLAGGED = pairs_sql(HOURLY, 12, Z, 3).replace("lo = hi AS const", "i % 5 = 0 AS const")


@query("self_join_flagged", f"WITH {_FLAGGED} {_NEAREST} FROM pairs GROUP BY ALL")
def self_join_flagged(spark: SparkSession, sf: str) -> DataFrame:
    s = S.hourly_events(spark, sf)
    return _flat_rows(P.self_join(s, 12, constant=s.select("series_id", F.col("idx").alias("i"), (F.col("idx") % 5 == 0).alias("is_const"))))


@query("mass_flagged", f"WITH w AS (SELECT * REPLACE (i % 5 = 0 AS const) FROM ({windows_sql(QUANTITY, M)})) SELECT y.series_id, y.i::BIGINT AS i, round(CASE WHEN y.i = {AT} THEN 0 ELSE {distance_sql(Z, M)} END, 6) AS d FROM (SELECT * REPLACE (false AS const) FROM w) x JOIN w y ON x.i = {AT}")
def mass_flagged(spark: SparkSession, sf: str) -> DataFrame:
    s = S.daily_quantity(spark, sf)
    flags = s.select("series_id", F.col("idx").alias("i"), (F.col("idx") % 5 == 0).alias("is_const"))
    return P.distance_profile(s, search.window_at(s, AT, M), query_index=AT, constant=flags, query_constant=False).withColumn("d", F.round("d", 6))


@query("discords_top3", f"""WITH RECURSIVE {pairs_sql(QUANTITY, M, Z, 4)}, p AS (SELECT i, min(d) AS d FROM pairs GROUP BY ALL),
picks(n, taken, d) AS (
  SELECT 1, [min(struct_pack(d := -d, i := i)).i], max(d) FROM p
  UNION ALL
  SELECT n + 1, list_append(taken, best.i), -best.d FROM (
    SELECT q.n, any_value(q.taken) AS taken, min(struct_pack(d := -p.d, i := p.i)) AS best FROM picks q, p WHERE q.n < 3 AND len(list_filter(q.taken, lambda t: abs(t - p.i) <= 4)) = 0 GROUP BY q.n))
SELECT 'quantity' AS series_id, n::INT AS rank, taken[n]::BIGINT AS i, round(d, 6) AS d FROM picks""")
def discords_top3(spark: SparkSession, sf: str) -> DataFrame:
    return P.discords(P.self_join(S.daily_quantity(spark, sf), M), M, k=3).withColumn("d", F.round("d", 6))


@query("distance_matrix", f"WITH x AS (SELECT * FROM ({windows_sql(TYPE_SERIES, TM)}) WHERE series_id = '0' AND i < 100), y AS (SELECT * FROM ({windows_sql(TYPE_SERIES, TM)}) WHERE series_id = '1' AND i < 100) SELECT x.series_id, x.i::BIGINT AS i, y.series_id AS other_id, y.i::BIGINT AS j, round({distance_sql(Z, TM)}, 6) AS d FROM x, y")
def distance_matrix(spark: SparkSession, sf: str) -> DataFrame:
    s = types_as_series(spark, sf).where(F.col("idx") < 99 + TM)
    return P.distance_matrix(s.where("series_id = '0'"), s.where("series_id = '1'"), TM).withColumn("d", F.round("d", 6))


# Streams: every user's events as a series


def _streamed(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Run a stream over the events table to its end; the rows it wrote."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    points = spark.readStream.schema(events.schema).parquet(f"{sf}/event[s].parquet").select(F.col("user_id").cast("string").alias("series_id"), "ts", "value", F.col("event_id").alias("seq"))
    return _run_stream(spark, name, build(points))


def _run_stream(spark: SparkSession, name: str, rows: DataFrame, base: str | None = None) -> DataFrame:
    """Run a stream until it has all its input; the rows it wrote, in all runs over the same ``base``."""
    base = base or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


def _stream_sql(metric: Metric) -> str:
    return f"""WITH {pairs_sql(USERS, 8, metric, 2)} SELECT w.series_id, w.i::BIGINT AS i, round(min(d), 6) AS d, coalesce(min(struct_pack(d := round(d, 9), j := j)).j, -1)::BIGINT AS j
FROM w LEFT JOIN pairs ON w.series_id = pairs.series_id AND w.i = pairs.i AND j < w.i WHERE w.i >= 3 GROUP BY 1, 2"""


def _profile_stream(metric: Metric):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _streamed(spark, sf, "profile", lambda p: incremental.profile_stream(p, 8, metric=metric))
        return rows.select("series_id", "i", F.round("d", 6).alias("d"), F.coalesce("j", F.lit(-1)).cast("long").alias("j"))

    return run


for _name, _metric in (("stream_profile", Z), ("stream_profile_minkowski", L2)):
    QUERIES[_name], ORACLES[_name] = _profile_stream(_metric), _stream_sql(_metric)


#: Whether a run ends with a micro-batch without input where the watermark has moved.
_FINAL = "spark.sql.streaming.noDataMicroBatches.enabled"


def _late(spark: SparkSession, sf: str, hours: int, slots: int) -> list[DataFrame]:
    """The events in slots of the time of arrival, each event up to ``hours`` after its time; with the last slot comes a point of
    a series of its own, so far ahead that the watermark passes all others."""
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("seq"))
    late = events.withColumn("arrival", F.unix_seconds("ts") + F.crc32(F.col("seq").cast("string").cast("binary")) % (hours * 3600))
    ends = late.agg(F.min("arrival").alias("low"), F.max("arrival").alias("high")).first()
    slot = F.least(F.floor((F.col("arrival") - ends["low"]) * slots / (ends["high"] - ends["low"] + 1)), F.lit(slots - 1))
    ahead = events.agg(F.max("ts").alias("ts")).select(F.lit("ahead").alias("series_id"), (F.col("ts") + F.expr(f"INTERVAL {10 * hours} HOURS")).alias("ts"), F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("seq"))
    parts = [late.where(slot == n).drop("arrival") for n in range(slots)]
    return [*parts[:-1], parts[-1].unionByName(ahead)]


@query("stream_late_profile", _stream_sql(Z))
def stream_late_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = _late_profile(spark, _late(spark, sf, 48, 4)).where("series_id != 'ahead'")
    return rows.select("series_id", "i", F.round("d", 6).alias("d"), F.coalesce("j", F.lit(-1)).cast("long").alias("j"))


def _late_profile(spark: SparkSession, slots: list[DataFrame]) -> DataFrame:
    """The stream is run anew, from where it was, whenever a slot has been written: however many files a slot has, they are one
    micro-batch, and nothing in a later slot is behind the watermark."""
    base = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    final = spark.conf.get(_FINAL)
    try:
        for n, slot in enumerate(slots):
            slot.write.mode("append").parquet(f"{base}/in")
            spark.conf.set(_FINAL, str(n == len(slots) - 1).lower())
            points = spark.readStream.schema("series_id string, ts timestamp, value double, seq long").parquet(f"{base}/in")
            rows = _run_stream(spark, "late", incremental.profile_stream(points, 8, delay="48 hours"), base)
    finally:
        spark.conf.set(_FINAL, final)
    return rows


@query("stream_whole_profile", f"""WITH {pairs_sql(USERS, 8, Z, 2)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id, i ORDER BY round(d, 9), j) AS rank FROM pairs),
long AS (SELECT series_id FROM w GROUP BY series_id HAVING count(*) >= 4)
SELECT series_id, w.i::BIGINT AS i, coalesce(rank, 1)::INT AS rank, round(d, 6) AS d, coalesce(j, -1)::BIGINT AS j FROM w JOIN long USING (series_id) LEFT JOIN (SELECT * FROM ranked WHERE rank <= 2) USING (series_id, i)""")
def stream_whole_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = _streamed(spark, sf, "whole", lambda p: incremental.profile_stream(p, 8, k=2, whole=True))
    return rows.select("series_id", "i", "rank", F.round("d", 6).alias("d"), F.coalesce("j", F.lit(-1)).cast("long").alias("j"))


# after each point: the windows of the last 40 points, each with its nearest to the right among them
_SEGMENTS = f"""WITH {pairs_sql(USERS, 5, Z, 2)}, ends AS (SELECT series_id, i + 4 AS e FROM w WHERE i + 4 >= 39),
links AS (SELECT series_id, e, i - (e - 39) AS i, n.j - (e - 39) AS j
  FROM (SELECT ends.series_id, e, w.i, min(struct_pack(d := round(d, 9), j := j)) AS n
    FROM ends JOIN w ON w.series_id = ends.series_id AND w.i BETWEEN e - 39 AND e - 4 LEFT JOIN pairs ON pairs.series_id = w.series_id AND pairs.i = w.i AND j > w.i AND j <= e - 4 GROUP BY ALL)),
steps AS (SELECT series_id, e, i, sum(s) AS s FROM (SELECT series_id, e, i, 1 AS s FROM links UNION ALL SELECT series_id, e, coalesce(j, i), -1 FROM links) GROUP BY ALL),
arcs AS (SELECT series_id, e, i, sum(s) OVER (PARTITION BY series_id, e ORDER BY i) AS arcs FROM steps),
h AS (SELECT n, coalesce((SELECT sum(1.0 / k) FROM (SELECT unnest(range(1, 40)) AS k) WHERE k <= n), 0) AS h FROM (SELECT unnest(range(0, 40)) AS n)),
ideal AS (SELECT a.n AS i, CASE WHEN a.n = 35 THEN 1e-10 ELSE (35 - a.n) * ((SELECT h FROM h WHERE n = 35) - b.h) + (a.n + 1) / 36 END AS ideal FROM h a JOIN h b ON b.n = greatest(34 - a.n, 0) WHERE a.n < 36),
cac AS (SELECT series_id, e, i, CASE WHEN i < 5 OR i >= 31 THEN 1.0 ELSE least(arcs / ideal, 1.0) END AS cac FROM arcs JOIN ideal USING (i))
SELECT series_id, (best.i + e - 39)::BIGINT AS i, round(best.cac, 6) AS cac FROM (SELECT series_id, e, min(struct_pack(cac := cac, i := i)) AS best FROM cac GROUP BY ALL)"""


@query("stream_segments", _SEGMENTS)
def stream_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, "segments", lambda p: incremental.segment_stream(p, 5, 5, 40, factor=1)).select("series_id", "i", F.round("cac", 6).alias("cac"))


_CURVES = _SEGMENTS[: _SEGMENTS.rindex("SELECT series_id, (best.i")] + "SELECT series_id, (c.i + e - 39)::BIGINT AS i, coalesce(j + e - 39, -1)::BIGINT AS j, round(cac, 6) AS cac FROM cac c JOIN links USING (series_id, e, i)"


@query("stream_curves", _CURVES)
def stream_curves(spark: SparkSession, sf: str) -> DataFrame:
    # what the query doesn't return isn't written either
    rows = _streamed(spark, sf, "curves", lambda p: incremental.segment_stream(p, 5, 5, 40, factor=1, whole=True).drop("ts", "d"))
    return rows.select("series_id", "i", F.coalesce("j", F.lit(-1)).cast("long").alias("j"), F.round("cac", 6).alias("cac"))


# Functions as arguments: constant windows, a bound of matches, steps of values, an expected curve


@query("self_join_flag_function", ORACLES["self_join_flagged"])
def self_join_flag_function(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_rows(P.self_join(S.hourly_events(spark, sf), 12, constant=lambda values, m: np.arange(len(values) - m + 1) % 5 == 0))


@query("match_bound_function", ORACLES["match"].replace("greatest(avg(d) - 2 * stddev_pop(d), min(d)) + 1e-8 AS b", "avg(d) - stddev_pop(d) + 1e-8 AS b"))
def match_bound_function(spark: SparkSession, sf: str) -> DataFrame:
    s = S.daily_quantity(spark, sf)
    found = search.match(s, search.window_at(s, AT, M), max_distance=lambda d: d.mean() - d.std(), max_matches=10, query_index=AT)
    return found.withColumn("d", F.round("d", 6))


@query("description_lengths_own_steps", ORACLES["description_lengths"].replace(f"len(list_filter({_EDGES}, lambda e: e < v))", "floor(v * 4)"))
def description_lengths_own_steps(spark: SparkSession, sf: str) -> DataFrame:
    d = multidim.description_lengths(S.hourly_events_by_type(spark, sf), TM, [AT] * 5, [OTHER] * 5, discretize=lambda windows: np.floor(windows * 4))
    return d.select("kdim", F.round("bits", 6).alias("bits"), F.array_join(F.array_sort("subspace").cast("array<string>"), ",").alias("subspace"))


@query("fluss_own_curve", ORACLES["fluss_curve"].replace("arcs / (2.0 * (i + 1) * (w - 1 - i) / w)", "arcs / (1.0 + i)"))
def fluss_own_curve(spark: SparkSession, sf: str) -> DataFrame:
    links = P.nearest(P.self_join(S.daily_quantity(spark, sf), M))
    expected = links.select("series_id", "i", (F.col("i") + 1.0).alias("iac"))
    return segment.arc_curve(links, M, expected=expected).withColumn("cac", F.round("cac", 6))


@query("sampled_profile_carried", ORACLES["sampled_profile"].replace('% 10 < 1)', '% 10 < 4)'))
def sampled_profile_carried(spark: SparkSession, sf: str) -> DataFrame:
    """A stored sample, carried on twice."""
    s = S.hourly_events(spark, sf)
    kept = cut(approximate.sampled_profile(s, 12, 0.1))
    kept = cut(approximate.updated_profile(kept, s, 12, 1, 1, 0.1))
    return _flat_rows(approximate.updated_profile(kept, s, 12, 2, 2, 0.1))


@query("consensus_rounds", ORACLES["ostinato"])
def consensus_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The consensus motif by rounds that carry a bound, whatever the number of tiles."""
    return _ostinato(Z, few=0)(spark, sf)


# The motif of several dimensions whose number the description length picks


def _motif_by_length_sql(metric: Metric) -> str:
    step = "len(list_filter({e}, lambda e: e < v))".format(e=_EDGES) if metric.normalized else "round_even((v - low) / (high - low) * 255, 0)"
    code = lambda side: f"list_transform({side}.{'z' if metric.normalized else 'a'}, lambda v: {step})"
    return f"""WITH RECURSIVE {_dims_pairs(metric, 'abs(x.i - y.i) > 3')}, p AS (SELECT kdim, i, min(struct_pack(q := round(d, 9), j := j, d := d)) AS n FROM multi GROUP BY kdim, i),
pair AS (SELECT kdim, t.i AS i, t.j AS j FROM (SELECT kdim, min(struct_pack(d := n.d, i := i, j := n.j)) AS t FROM p GROUP BY kdim)),
span AS (SELECT min(value) AS low, max(value) AS high FROM ({TYPES})),
codes AS (SELECT kdim, x.dim, {code("x")} AS a, {code("y")} AS b FROM pair JOIN w x ON x.i = pair.i JOIN w y ON y.i = pair.j AND y.dim = x.dim, span),
ranked AS (SELECT kdim, dim, list_transform(list_zip(a, b), lambda t: t[1] - t[2]) AS diff,
  row_number() OVER (PARTITION BY kdim ORDER BY sqrt(list_sum(list_transform(list_zip(a, b), lambda t: pow(t[1] - t[2], 2)))), dim) AS r FROM codes),
size AS (SELECT kdim, 8.0 * (2 * 5 * {TM} - (kdim + 1) * {TM}) + (kdim + 1) * {TM} * log2(count(DISTINCT v)) + count(DISTINCT v) * 8 AS bits
  FROM (SELECT kdim, unnest(diff) AS v FROM ranked WHERE r <= kdim + 1) GROUP BY kdim),
pick AS (SELECT kdim, bits FROM size ORDER BY round(bits, 9), kdim LIMIT 1),
own AS (SELECT pair.i, pair.j FROM pair JOIN pick USING (kdim)), chosen AS (SELECT dim, r FROM ranked JOIN pick USING (kdim) WHERE r <= kdim + 1),
prof AS MATERIALIZED (SELECT y.i, CASE WHEN y.i = own.i THEN 0 ELSE avg({distance_sql(metric, TM)}) END AS d FROM own JOIN w x ON x.i = own.i JOIN chosen ON chosen.dim = x.dim JOIN w y ON y.dim = x.dim GROUP BY y.i, own.i),
bound AS (SELECT greatest(avg(d) - 2 * stddev_pop(d), min(d)) + 1e-8 AS b FROM prof),
picks(n, taken, d) AS (
  SELECT 1, [i], 0.0::DOUBLE FROM own
  UNION ALL
  SELECT n + 1, list_append(taken, best.i), best.d FROM (
    SELECT q.n, any_value(q.taken) AS taken, min(struct_pack(d := prof.d, i := prof.i)) AS best FROM picks q, prof, bound
    WHERE q.n < 10 AND prof.d <= b AND len(list_filter(q.taken, lambda t: abs(t - prof.i) <= 3)) = 0 GROUP BY q.n))
SELECT 0 AS motif, n::INT AS rank, taken[n]::BIGINT AS i, round(d, 6) AS d, (SELECT kdim FROM pick)::INT AS kdim, (SELECT string_agg(dim::VARCHAR, ',' ORDER BY r) FROM chosen) AS subspace, (SELECT round(bits, 6) FROM pick) AS bits FROM picks"""


def _motif_by_length(metric: Metric):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = S.hourly_events_by_type(spark, sf)
        found = multidim.multi_motifs(s, multidim.multi_profile(s, TM, metric=metric), TM, cutoffs=float("inf"), metric=metric)
        return found.withColumns({"d": F.round("d", 6), "bits": F.round("bits", 6), "subspace": F.array_join(F.col("subspace").cast("array<string>"), ",")})

    return run


for _name, _metric in (("multi_motif_by_length", Z), ("multi_motif_by_length_minkowski", L2)):
    QUERIES[_name], ORACLES[_name] = _motif_by_length(_metric), _motif_by_length_sql(_metric)
