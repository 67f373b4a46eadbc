"""Embedding near-dedup by spherical-cap filters of a structured random product code.

A vector is rotated at random and cut in two halves; each half has a number of random directions that grows with the
largest label, and a filter is a pair of them, so n ** 2 caps cost only 2 x n products. Every vector is stored under the
filter it exceeds most, which is the best direction of each half. It is also list-decoded to every filter that a vector
at the threshold cosine could have as its best: a neighbour differs by a vector of known length whose direction is
random to the code, so each filter has a distance in standard deviations, and all within ``SPREAD`` are taken (a pair at
the threshold itself is missed with a probability below 1e-5, closer ones less; ``tests/llm`` measure recall against
brute force). A vector travels once to each first direction that it probes, with the list of its second ones; there
stored and probing vectors are joined on the whole filter by a sorted index, and only those pairs are verified, by
their cosine in double precision. As each vector is stored once, each ordered pair is seen once: links are counted,
never listed.

Identical vectors of a label are one class with a multiplicity. Cells of a hot direction are dealt into blocks on both
sides. Only link counts and spanning edges leave a cell.

Edge cases: a null label, a null vector, one without components, a zero vector or one with null or non-finite
components links with nothing (n_links 0, its own component, kept); vectors of different lengths don't link; a row
without vec_id links with nothing; repeated rows of a vec_id are one vector (n_links counts other ids), and of different
vectors under one vec_id each row is judged by its own: it links with the other ids near it, and the id's component is
the least that any of them reaches; a cosine of exactly the threshold links; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.components import components
from tidewheel.llm.minhash import runs
from tidewheel.llm.worker import ready, tidy
from tidewheel.runtime import cut, table

#: Directions of a half: the least, and the most that are used however large a label is.
DIRECTIONS, MOST_DIRECTIONS = 64, 1024
#: Vectors of a label for each filter, before more directions are taken.
PER_FILTER = 16
SPREAD = 5.0
COSINE = 0.98
STORED_BLOCK, PROBE_BLOCK = 512, 2048


def directions(largest: int) -> int:
    """Directions of a half for a label of this many vectors: a power of two."""
    n = DIRECTIONS
    while n < MOST_DIRECTIONS and n * n * PER_FILTER < largest:
        n *= 2
    return n


@lru_cache(maxsize=8)
def code(dim: int, n: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rotation, ``n`` directions of both halves, distances between the directions of a half."""
    rng = np.random.default_rng(977 + dim)
    rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    halves, apart = [], []
    for size in (dim - dim // 2, dim // 2):
        if size == 0:
            c = np.zeros((1, 0))
        else:
            c = rng.normal(size=(n, size))
            c /= np.linalg.norm(c, axis=1, keepdims=True)
        halves.append(c)
        apart.append(np.sqrt(np.maximum(0, 2 - 2 * c @ c.T)))
    return rotation, halves, apart


def decode(unit: np.ndarray, cosine: float, n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Best direction of the first and of the second half, and the distances of both halves' directions, squared."""
    dim = unit.shape[1]
    rotation, halves, apart = code(dim, n)
    turned = unit @ rotation
    step = np.sqrt(2 - 2 * cosine) / np.sqrt(dim)
    best, far = [], []
    for part, c, d in zip((turned[:, : dim - dim // 2], turned[:, dim - dim // 2 :]), halves, apart, strict=True):
        s = part @ c.T
        top = s.argmax(axis=1)
        gap = s[np.arange(len(s)), top][:, None] - s
        reach = d[top] * step
        far.append(np.where(gap <= 0, 0.0, gap / np.maximum(reach, 1e-12)) ** 2)
        best.append(top)
    return best[0], best[1], far


def _decode(cosine: float, n: int, vectors: bool):
    """Rows (key, rep, weight, embedding) to (key, first, stored) and, with ``vectors``, (rep, weight, second, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x) for x in batch.column(3)], np.int64)
            values = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.cumsum(size)])
            for dim in np.unique(size).tolist():
                for rows in np.array_split(np.flatnonzero(size == dim), max(1, int((size == dim).sum()) // 256)):
                    if not len(rows):
                        continue
                    raw = values[start[rows][:, None] + np.arange(dim)]
                    first, second, (far1, far2) = decode(_unit(raw), cosine, n)
                    least2 = far2.min(axis=1)
                    of, at = np.nonzero(far1 + least2[:, None] <= SPREAD**2)
                    lists = [np.flatnonzero(p).astype(np.int16) for p in far1[of, at][:, None] + far2[of] <= SPREAD**2] if vectors else []
                    of = np.concatenate([of, np.arange(len(rows))])
                    at = np.concatenate([at, first])
                    stored = np.zeros(len(of), bool)
                    stored[len(of) - len(rows) :] = True
                    columns = [batch.column(0).take(pa.array(rows[of])), pa.array(at.astype(np.int32)), pa.array(stored)]
                    names = ["key", "first", "stored"]
                    if vectors:
                        lists += [np.array([s], np.int16) for s in second]
                        # as they are given: a float is half as long, and equal as a double
                        columns += [*(batch.column(i).take(pa.array(rows[of])) for i in (1, 2)), pa.array([x.tobytes() for x in lists], pa.binary()), pa.array([raw[i].tobytes() for i in of], pa.binary())]
                        names += ["rep", "weight", "second", "vec"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return tidy(run)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Pairs of a filter that are verified at once.
PAIRS = 1 << 16


def _pairs(stored: np.ndarray, lists: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(probing, stored) rows that share a filter: ``stored`` has a second direction a row, ``lists`` those probed."""
    order = np.argsort(stored, kind="stable")
    sorted_second = stored[order]
    size = np.array([len(x) for x in lists])
    probe = np.repeat(np.arange(len(lists)), size)
    second = np.concatenate(lists)
    low, high = np.searchsorted(sorted_second, second, "left"), np.searchsorted(sorted_second, second, "right")
    met = high > low
    probe, low, count = probe[met], low[met], (high - low)[met]
    total = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
        n = count[a:b]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(probe[a:b], n), order[np.repeat(low[a:b], n) + within]
        a = b


def _link(cosine: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, 4):
            stored = cell.column(4).to_numpy(zero_copy_only=False)
            if stored.all() or not stored.any():
                continue
            rep, weight = cell.column(5).to_numpy(), cell.column(6).to_numpy()
            unit = _unit(np.frombuffer(b"".join(cell.column(8).to_pylist()), kind).reshape(len(rep), -1))
            lists = [np.frombuffer(x, np.int16) for x in cell.column(7).to_pylist()]
            s, p = np.flatnonzero(stored), np.flatnonzero(~stored)
            of_stored = np.array([lists[i][0] for i in s.tolist()])
            found = []
            for i, j in _pairs(of_stored, [lists[i] for i in p.tolist()]):
                x, y = p[i], s[j]
                near = (rep[x] != rep[y]) & (np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine)
                found.append(np.stack([rep[x[near]], rep[y[near]], weight[y[near]]]))
            a, b, links = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
            if not len(a):
                continue
            # links by probing vector, and a star around one stored vector of each component of the cell
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            one, two = at[: len(a)], at[len(a) :]
            label = np.arange(len(nodes))
            while True:
                new = label.copy()
                np.minimum.at(new, one, label[two])
                np.minimum.at(new, two, label[one])
                new = new[new]
                if (new == label).all():
                    break
                label = new
            count = np.zeros(len(nodes), np.int64)
            np.add.at(count, one, links)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label]), pa.array(count)], names=["a", "b", "links"])

    return tidy(run)


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    ready(vectors.sparkSession)
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    key = F.concat(F.size("embedding").cast("string"), F.lit(":"), F.col("label"))
    sound_row = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    keyed = given.where(F.col("vec_id").isNotNull() & sound_row).withColumns({"key": key, "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    members = cut(keyed.select("key", "h1", "h2", "vec_id").distinct())
    # an id with different vectors may be the first of several classes, so classes have numbers of their own
    classes = cut(members.groupBy("key", "h1", "h2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight")).withColumn("rep", F.monotonically_increasing_id()))
    reps = keyed.join(classes, ["key", "h1", "h2"]).where("vec_id = first").dropDuplicates(["rep"]).select("key", "rep", "weight", "embedding")
    n = directions(classes.groupBy("key").count().agg(F.max("count")).first()[0] or 0)

    sizes = reps.mapInArrow(_decode(cosine, n, False), "key string, first int, stored boolean").groupBy("key", "first").agg(F.count_if("stored").alias("stored"), F.count_if(~F.col("stored")).alias("probes"))
    dealt = cut(
        sizes.where("stored > 0 AND probes > 1").select(
            "key", "first", F.ceil(F.col("stored") / STORED_BLOCK).cast("int").alias("_s"), F.ceil(F.col("probes") / PROBE_BLOCK).cast("int").alias("_p")
        )
    )
    coded = reps.mapInArrow(_decode(cosine, n, True), "key string, first int, stored boolean, rep long, weight long, second binary, vec binary")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = (
        coded.join(dealt, ["key", "first"])
        .withColumn("cell_s", F.explode(F.when(F.col("stored"), F.array(block("_s"))).otherwise(every("_s"))))
        .withColumn("cell_p", F.explode(F.when(F.col("stored"), every("_p")).otherwise(F.array(block("_p")))))
    )
    cells = placed.repartition("key", "first", "cell_s", "cell_p").sortWithinPartitions("key", "first", "cell_s", "cell_p")
    found = cut(cells.select("key", "first", "cell_s", "cell_p", "stored", "rep", "weight", "second", "vec").mapInArrow(_link(cosine, kind), "a long, b long, links long"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
    # the vectors of one id belong together
    owned = members.join(classes, ["key", "h1", "h2"]).select("vec_id", "rep")
    several = owned.groupBy("vec_id").agg(F.min("rep").alias("b"), F.max("rep").alias("c")).where("b < c").select("vec_id", "b")
    linked = components(found.select("a", "b").unionAll(owned.join(several, "vec_id").select(F.col("rep").alias("a"), "b")))
    joined = classes.join(counts, "rep", "left").join(linked, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    of_class = cut(joined.join(least, "component").select("key", "h1", "h2", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n"), "least"))
    good = sound_row & F.col("vec_id").isNotNull()
    rows = given.select("vec_id", F.when(good, key).alias("key"), F.when(good, F.xxhash64("embedding")).alias("h1"), F.when(good, F.xxhash64(F.lit(1), "embedding")).alias("h2"))
    component = F.coalesce("least", "vec_id")
    return rows.join(of_class, ["key", "h1", "h2"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept")
    )


def op3_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(v, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT v, min(r) AS c FROM reach GROUP BY v),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id::BIGINT AS vec_id, coalesce(n, 0)::BIGINT AS n_links, c::BIGINT AS component_id, c = vec_id AS kept
FROM embeddings JOIN least ON v = vec_id LEFT JOIN counts ON a = vec_id
"""
