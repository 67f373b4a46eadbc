"""MinHash near-dedup with odd sketches.

1. A pass over whole texts makes each document's distinct shingle hashes, a 128-bit signature of that set, MinHash
   samples folded into band keys, and an odd sketch: the parity bitmap of the samples.
2. Documents of equal sets are one class, so exact copies cost one row each from here on.
3. Classes that share a band meet (buckets above ``BLOCK`` members in block-by-block cells, so no task holds one);
   the XOR population count of two sketches keeps the pairs that can be similar enough. Only spanning edges leave.
4. The components of those edges are candidate groups. A bitmap of their documents goes to a second scan, so that only
   their full sets move; each group's sets are brought together once and its pairs confirmed on them exactly; groups
   above ``BLOCK`` documents again in cells. Spanning edges of confirmed links give the final components.

With 128 samples in bands of 5 a pair at similarity 0.85 shares no band with probability 1e-6 (bands of 4 at 0.8:
5e-8), and the sketch bound lies six standard deviations from such a pair.

Edge cases: null, empty and blank texts have an empty set, link with nothing and are kept; a text of fewer words than
a shingle is one shingle; a row without doc_id links with nothing and is kept; repeated rows of one doc_id are each in the
result, with one component; different texts under one doc_id belong to one component, and each row has the size of its
own set; a similarity of exactly the threshold links; very long texts count whole; an empty table gives no rows; extra
columns are ignored by ``near_duplicates`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import textvec
from tidewheel.llm.bitmap import bitmap
from tidewheel.llm.components import components
from tidewheel.llm.worker import ready, tidy
from tidewheel.runtime import cut, table

SAMPLES = 128
SKETCH_BITS = 1024
#: Members of a bucket, or documents of a group, that are compared in one piece.
BLOCK = 512
#: Shingles of a block's documents.
BLOCK_SHINGLES = 1 << 20

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_U = np.uint64


def band_rows(percent: int) -> int:
    """Rows of a band: the most with which a pair at the threshold is missed with probability below 2e-6."""
    rows = 2
    while (1 - (percent / 100) ** (rows + 1)) ** (SAMPLES // (rows + 1)) < 2e-6:
        rows += 1
    return rows


def sketch_limit(percent: int) -> int:
    """Most differing bits of the sketches of a pair at the threshold: each differing sample flips two bits at most."""
    differ = SAMPLES * (1 - percent / 100)
    return int(2 * (differ + 6 * (differ * percent / 100) ** 0.5))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples (uint32) of a set of 64-bit hashes."""
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    folded = (shingles >> _U(32)).astype(np.uint32)
    for a in range(0, len(folded), 1024):
        np.minimum(low, ((folded[a : a + 1024, None] ^ _XOR) * _ODD).min(axis=0), out=low)
    return low


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    """Key of each band, for samples of many documents."""
    n = SAMPLES // rows
    wide = samples[:, : n * rows].reshape(len(samples), n, rows).astype(np.uint64)
    keys = np.broadcast_to(textvec.mix(np.arange(1, n + 1, dtype=np.uint64)), (len(samples), n)).copy()
    for i in range(rows):
        keys = textvec.mix(keys + wide[:, :, i])
    return keys


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(documents, SKETCH_BITS / 8) bytes: each (position, sample) flips one bit."""
    at = textvec.mix(samples.astype(np.uint64) + (np.arange(1, SAMPLES + 1, dtype=np.uint64) << _U(32))) % _U(SKETCH_BITS)
    bits = np.zeros((len(samples), SKETCH_BITS), np.uint8)
    np.bitwise_xor.at(bits, (np.arange(len(samples))[:, None], at.astype(np.int64)), 1)
    return np.packbits(bits, axis=1)


def estimate(differing: int | np.ndarray) -> np.ndarray:
    """Similarity that a count of differing sketch bits stands for."""
    share = np.minimum(2 * np.asarray(differing) / SKETCH_BITS, 0.999)
    return 1 + SKETCH_BITS * np.log(1 - share) / (4 * SAMPLES)


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set."""
    return int(shingles.sum(dtype=np.uint64)), int(textvec.mix(shingles).sum(dtype=np.uint64))


_SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, odd binary"


def _sign(width: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in textvec.chunks(batch.column(1)):
                hashes, at = textvec.word_hashes(data, offsets)
                n = end - first
                sizes, signs = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
                samples = np.zeros((n, SAMPLES), np.uint32)
                for i, s in enumerate(textvec.row_shingles(hashes, at, width)):
                    sizes[i] = len(s)
                    if len(s):
                        signs[i] = signature(s)
                        samples[i] = minhash(s)
                full = sizes > 0
                keys = band_keys(samples, rows).view(np.int64)
                values = pa.array(keys[full].ravel())
                lengths = np.concatenate([[0], np.cumsum(full * keys.shape[1])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n), pa.array(sizes), pa.array(signs[:, 0].view(np.int64)), pa.array(signs[:, 1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(lengths), values), pa.array([x.tobytes() for x in odd_sketches(samples)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "s1", "s2", "bands", "odd"],
                )

    return tidy(run)


def cells(members: DataFrame, sizes: DataFrame, key: str, by: str) -> DataFrame:
    """Members with the columns cell_i and cell_j of every cell of their group that they take part in.

    ``sizes`` has the groups wanted and their number of _blocks. A group of one block is one cell. A larger one is
    dealt into blocks by a hash of ``by``, and each pair of blocks is a cell, so every pair of members meets and a
    group never meets in a single task.
    """
    dealt = members.join(sizes, key).withColumn("_own", F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int"))
    return dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        *members.columns, F.least("_own", "_other").alias("cell_i"), F.greatest("_own", "_other").alias("cell_j")
    )


def together(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a cell side by side, in a partition each task can stream."""
    return rows.repartition(key, "cell_i", "cell_j").sortWithinPartitions(key, "cell_i", "cell_j")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose first ``keys`` columns are equal, as one batch each; and many runs are never held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if held and last != tuple(c[0] for c in cols):
            yield _joined(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a and held:
                yield _joined(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph of a square boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        least = np.where(linked, label[None, :], n).min(axis=1)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(i, int(label[i])) for i in np.flatnonzero(label != np.arange(n)).tolist()]


_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _differing(odd: np.ndarray) -> np.ndarray:
    """Differing bits of every two sketches."""
    words = odd.view(np.uint64)
    out = np.zeros((len(odd), len(odd)), np.int32)
    for i in range(words.shape[1]):
        out += np.bitwise_count(words[:, i][:, None] ^ words[:, i][None, :])
    return out


def _edges(found_a: list, found_b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])


def _candidates(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_out: list[int] = []
        b_out: list[int] = []
        for cell in runs(batches, 3):
            if cell.num_rows < 2:
                continue
            ids = cell.column(3).to_numpy()
            odd = np.frombuffer(b"".join(cell.column(4).to_pylist()), np.uint8).reshape(len(ids), -1)
            if len(ids) == 2:
                if int(np.bitwise_count(odd[0].view(np.uint64) ^ odd[1].view(np.uint64)).sum()) <= limit:
                    a_out.append(int(ids[0]))
                    b_out.append(int(ids[1]))
            else:
                for i, j in spanning(_differing(odd) <= limit):
                    a_out.append(int(ids[i]))
                    b_out.append(int(ids[j]))
            if len(a_out) > 10_000:
                yield _edges(a_out, b_out)
                a_out, b_out = [], []
        yield _edges(a_out, b_out)

    return tidy(run)


def _sets(width: int, shared):
    """Rows (doc_id, text) that may be in the broadcast bitmap to (doc_id, s1, s2, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(wanted.may(batch.column(0).to_numpy())))
            for first, end, data, offsets in textvec.chunks(batch.column(1)):
                hashes, at = textvec.word_hashes(data, offsets)
                sets = list(textvec.row_shingles(hashes, at, width))
                s1, s2 = np.array([signature(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64).T
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(s1), pa.array(s2), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "s1", "s2", "shingles"])

    return tidy(run)


def confirmed(sets: list[np.ndarray], percent: int, budget: int = 4 << 20) -> np.ndarray:
    """Boolean matrix of the pairs whose exact similarity reaches percent / 100.

    Shared shingles are numbered and intersections counted by matrix products over slices of ``budget`` cells.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    row = np.repeat(np.arange(n), size)
    _, at, count = np.unique(values, return_inverse=True, return_counts=True)
    common = count[at] > 1
    row, at = row[common], at[common]
    # numbers of the shared shingles, ascending in their order
    _, at = np.unique(at, return_inverse=True)
    both = np.zeros((n, n), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        step = max(1, budget // n)
        for lo in range(0, int(at[-1]) + 1, step):
            a, b = np.searchsorted(at, [lo, lo + step])
            m = np.zeros((n, min(step, int(at[-1]) + 1 - lo)), np.float32)
            m[row[a:b], at[a:b] - lo] = 1
            both += m @ m.T
    inter = np.rint(both).astype(np.int64)
    union = size[:, None] + size[None, :] - inter
    return 100 * inter >= percent * union


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_out: list[int] = []
        b_out: list[int] = []
        for cell in runs(batches, 3):
            if cell.num_rows < 2:
                continue
            ids = cell.column(3).to_numpy()
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in cell.column(4)]
            if len(ids) == 2:
                inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
                if 100 * inter >= percent * (len(sets[0]) + len(sets[1]) - inter):
                    a_out.append(int(ids[0]))
                    b_out.append(int(ids[1]))
            else:
                for i, j in spanning(confirmed(sets, percent)):
                    a_out.append(int(ids[i]))
                    b_out.append(int(ids[j]))
            if len(a_out) > 10_000:
                yield _edges(a_out, b_out)
                a_out, b_out = [], []
        yield _edges(a_out, b_out)

    return tidy(run)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id) of each row."""
    ready(docs.sparkSession)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = cut(given.mapInArrow(_sign(width, band_rows(percent)), _SIGNED))
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # an id with different texts may be the first of several classes, so classes have numbers of their own
    classes = cut(full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("first")).withColumn("rep", F.monotonically_increasing_id()))
    key = ["s1", "s2", "n_shingles"]
    reps = cut(full.join(classes, key).where("doc_id = first").dropDuplicates(["rep"]).select("rep", "n_shingles", "bands", "odd"))

    banded = reps.select(F.explode("bands").alias("band"), "rep")
    shared = cut(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("_blocks")))
    meeting = cells(banded, shared, "band", "rep").join(reps.select("rep", "odd"), "rep")
    candidates = together(meeting.select("band", "cell_i", "cell_j", "rep", "odd"), "band").mapInArrow(_candidates(sketch_limit(percent)), "a long, b long")
    found = components(candidates)

    grouped = found.select(F.col("component").alias("grp"), F.col("node").alias("rep")).unionAll(found.select(F.col("component").alias("grp"), F.col("component").alias("rep")).distinct())
    weighed = grouped.join(reps.select("rep", "n_shingles"), "rep").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    blocks = weighed.select("grp", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("_blocks"))
    wanted = cut(grouped.join(classes, "rep").select("grp", "rep", "first", "s1", "s2"))
    members = cells(wanted.select("grp", "rep"), blocks, "grp", "rep")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select("first"), wanted.count()))  # of bounded size
    of_doc = given.where("doc_id IS NOT NULL").mapInArrow(_sets(width, bits), "doc_id long, s1 long, s2 long, shingles binary")
    named = wanted.select("rep", F.col("first").alias("doc_id"), "s1", "s2")
    sets = of_doc.join(named, ["doc_id", "s1", "s2"]).dropDuplicates(["rep"]).select("rep", "shingles")
    confirmed_in = members.join(sets, "rep").select("grp", "cell_i", "cell_j", "rep", "shingles")
    links = cut(together(confirmed_in, "grp").mapInArrow(_confirm(percent), "a long, b long"))
    # the texts of one id belong together
    owned = full.select("doc_id", *key).distinct().join(classes, key).select("doc_id", "rep")
    several = owned.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("c")).where("b < c").select("doc_id", "b")
    linked = components(links.unionAll(owned.join(several, "doc_id").select(F.col("rep").alias("a"), "b")))

    joined = classes.join(linked, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    of_class = cut(joined.join(least, "component").select(*key, "least"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return signed.select("doc_id", *key).join(of_class, key, "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Documents without the near duplicates of a kept one; columns as given."""
    (name,) = textvec.fresh(docs.columns, "_dropped")
    dropped = near_duplicates(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias(name))
    return docs.join(dropped, F.col("doc_id") == F.col(name), "left_anti")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) END AS s FROM words),
classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
-- the rarest shingles first: a pair at 0.85 shares one of the first 15 % of both
freq AS (SELECT x, count(*) AS f FROM (SELECT unnest(s) AS x FROM classes) GROUP BY x),
ranked AS (SELECT rep, x, n, row_number() OVER (PARTITION BY rep ORDER BY f, x) AS k FROM (SELECT rep, len(s) AS n, unnest(s) AS x FROM classes) JOIN freq USING (x)),
prefixes AS (SELECT rep, x, n FROM ranked WHERE k <= n - ceil(0.85 * n) + 1),
pairs AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM prefixes a JOIN prefixes b ON a.x = b.x AND a.rep < b.rep AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n),
links AS (
  SELECT a, b FROM (SELECT a, b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS t FROM pairs JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b)
  WHERE 100 * i >= 85 * (t - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(rep, to_rep) AS (SELECT rep, rep FROM classes UNION SELECT r.rep, e.b FROM reach r JOIN edges e ON r.to_rep = e.a),
component AS (SELECT rep, min(to_rep) AS c FROM reach GROUP BY rep)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN component USING (rep)
"""
