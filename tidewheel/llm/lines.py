"""Line dedup by a segment-partition edit join.

Lines are linked if they are equal, or if at most so many edits (inserted, deleted or replaced code points) lie between
them as the tier of the shorter one allows: ``TIERS`` lists the least length and the edits of each. Of each component of
linked lines the first occurrence in the corpus (smallest document, then row, then position) stays; all other
occurrences are taken out of their texts. Equality alone needs ``exact_chars`` characters and no edits.

1. One pass over whole texts gives each line's identity (a 128-bit cryptographic hash) and, once a chunk for repeated
   lines, its join keys. A tier of ``e`` edits cuts ``e`` + 1 segments of one size off a line, half of them counted from
   its start and half from its end. Of a line within ``e`` edits either the segment ``i`` from the start is intact and
   has at most ``i`` edits before it, or the segment ``i`` from the end is and has at most ``i`` after it (else each of
   the ``e`` + 1 segments would need an edit of its own). So a line stores its segments, and probes the substrings at up
   to ``i`` places to either side of segment ``i``; a line little longer than a tier's least length probes the tier
   below too.
2. Keys with a stored line and another line are found first (partial aggregates, no lists), and of keys with the same
   lines one is kept, so that a key that very many lines share is dealt into blocks: its lines meet in cells of two blocks, never in one task. The lines of a cell are
   compared with those of a like length by letter counts, then by banded bit-parallel edit distance (many pairs at a
   time, of small cells together), and only if the cell hasn't connected them yet. Spanning edges leave a cell, never pairs.
3. Only the texts of candidate lines travel to the cells, and only documents that lose a line meet their list of drops:
   bitmaps (``bitmap.BITMAP`` bits at most) over hashes go to the scans, and the joins after them are exact.

Edge cases: null and empty texts and blank lines stay as they are; rows without doc_id pass unchanged; an empty table
gives no rows; rows of one doc_id with different texts are rows of their own, and repeated rows of one id and text are
copies that keep the same lines; ties can't occur, for a line's place is unique; very long texts count whole, in
chunks of their own; a document that loses every line that isn't blank goes in ``drop_lines``; extra columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tidewheel.llm import textvec
from tidewheel.llm.bitmap import Bitmap, bitmap, through
from tidewheel.llm.components import components
from tidewheel.llm.minhash import runs
from tidewheel.llm.worker import ready, tidy
from tidewheel.runtime import cut, table

#: Least length and edits of each tier; tiers of equal edits only differ in the size of their segments.
TIERS = ((20, 1), (40, 2), (80, 3), (200, 5), (400, 5), (800, 5))
#: Equal lines need no length: the query and the pipeline link them from one character on.
EXACT_CHARS = 1
BLOCK = 2048
#: Pairs that are compared together, code points of them at a time, and how few are compared one by one.
PAIRS, COLUMNS, FEW = 4096, 64, 12
#: Code points of lines that are counted together, and edits at most whose band fits 32 bits.
LOT, MOST_EDITS = 1 << 20, 14
#: Bytes of a chunk of the scans.
SCANNED = 1 << 19
_U = np.uint64
_BLANK = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
_ODD = _U(0xC2B2AE3D27D4EB4F)
_NONE = np.uint32(0xFFFFFFFF)

Tiers = Sequence[tuple[int, int]]


def halves(edits: int) -> tuple[int, int]:
    """Segments counted from the start and from the end."""
    return (edits + 2) // 2, (edits + 1) // 2


def probes(edits: int) -> Iterator[tuple[int, int, int]]:
    """(side, segment, shift) of every place where a near line can have a segment; shift 0 is the segment's own."""
    for side, n in enumerate(halves(edits)):
        for i in range(n):
            for shift in range(-i, i + 1):
                yield side, i, shift


def identities(raw: bytes, bounds: Iterable[tuple[int, int]]) -> np.ndarray:
    """(ranges, 2): the halves of the hash of each range of bytes."""
    digest = hashlib.blake2b
    return np.frombuffer(b"".join([digest(raw[a:b], digest_size=16).digest() for a, b in bounds]), np.int64).reshape(-1, 2)


class Lines:
    """Lines of a chunk of rows as ranges of code points and of bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_chars: int, exact_chars: int | None = None):
        self.raw = data.tobytes()
        text = self.raw.decode("utf-8", "replace")
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        # bytes that begin a code point number the points
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        rows = lead[offsets] if lead[-1] == len(self.points) else self._slow(data, offsets)
        breaks = np.flatnonzero(self.points == 10)
        before = np.searchsorted(breaks, rows)
        count = np.diff(before) + 1
        last = np.cumsum(count) - 1
        first = last - count + 1
        row = np.repeat(np.arange(len(count)), count)

        def bounds(rows: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            start, end = np.empty((2, len(row)), np.int64)
            inner = np.ones(len(row), bool)
            inner[first] = False
            start[first], start[inner] = rows[:-1], breaks + 1
            inner[:] = True
            inner[last] = False
            end[last], end[inner] = rows[1:], breaks
            return start, end

        start, end = bounds(rows, breaks)
        good = end - start >= min_chars
        if exact_chars is not None and exact_chars < min_chars:
            solid = np.concatenate([[0], np.cumsum(~np.isin(self.points, _BLANK))])
            good |= (end - start >= exact_chars) & (solid[end] > solid[start])
        self.row, self.pos = row[good], (np.arange(len(row)) - first[row])[good]
        self.start, self.size = start[good], (end - start)[good]
        at, to = bounds(offsets, np.flatnonzero(data == 10))
        self.bytes_at, self.bytes_to = at[good], to[good]

    @staticmethod
    def _slow(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Row starts in code points where bytes aren't valid UTF-8."""
        sizes = [len(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.concatenate([[0], np.cumsum(sizes)])

    def identities(self) -> np.ndarray:
        """(lines, 2): the halves of each line's identity."""
        return identities(self.raw, zip(self.bytes_at.tolist(), self.bytes_to.tolist(), strict=True))

    def prefix(self) -> np.ndarray:
        textvec._powers.upto(len(self.points) + 1)
        total = np.zeros(len(self.points) + 1, np.uint64)
        value = (self.points.astype(np.uint64) + _U(1)) * _ODD
        value ^= value >> _U(29)
        np.cumsum(value * textvec._powers.up[: len(self.points)], out=total[1:])
        return total

    def keys(self, tiers: Tiers) -> tuple[np.ndarray, np.ndarray]:
        """Join keys and the line of each; stored ones are even numbers, probes odd ones."""
        total = self.prefix()
        keys, owners = [], []
        for t, (least, edits) in enumerate(tiers):
            size = least // (edits + 1)
            above = tiers[t + 1][0] if t + 1 < len(tiers) else None
            own = self.size >= least
            near = np.zeros(len(own), bool)
            if above is not None:
                near = (self.size >= above) & (self.size < above + edits)
                own &= self.size < above
            for lines, stores in ((np.flatnonzero(own), True), (np.flatnonzero(near), False)):
                if not len(lines):
                    continue
                start, length = self.start[lines], self.size[lines]
                for side, i, shift in probes(edits):
                    at = (i * size if side == 0 else length - (i + 1) * size) + shift
                    good = (at >= 0) & (at + size <= length)
                    begin = (start + at)[good]
                    key = textvec.mix(textvec.spans(total, begin, begin + size) + _U(t << 16 | side << 8 | i))
                    keys.append((key & ~_U(1)) | _U(not (stores and shift == 0)))
                    owners.append(lines[good])
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(keys), np.concatenate(owners)


_LINES = StructType([StructField("doc_id", LongType()), StructField("row", LongType()), StructField("pos", IntegerType()), StructField("h1", LongType()), StructField("h2", LongType()), StructField("keys", ArrayType(LongType()))])


def _scan(tiers: Tiers, exact_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in textvec.chunks(batch.column(2), SCANNED):
                own = Lines(data, offsets, tiers[0][0], exact_chars)
                if not len(own.row):
                    continue
                h = own.identities()
                keys, of = own.keys(tiers)
                once = np.zeros(len(h), bool)
                once[np.unique(h[:, 0], return_index=True)[1]] = True
                keep = once[of]
                keys, of = keys[keep], of[keep]
                order = np.argsort(of, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(h)))]).astype(np.int32)
                at = pa.array(own.row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first).take(at), batch.column(1).slice(first, end - first).take(at), pa.array(own.pos.astype(np.int32)),
                        pa.array(h[:, 0]), pa.array(h[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order].view(np.int64))),
                    ],
                    names=_LINES.names,
                )

    return tidy(run)


def _letters(text: str) -> np.ndarray:
    """Counts of code points mod 64."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) & 63, minlength=64)


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: a band of 2 x edits + 1 diagonals as bits of one number.

    ``up`` and ``down`` hold where the cells of a column step up or down by one from cell to cell; the distance is
    followed along the band's lowest diagonal, then along the last row.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    a, b = a[lo:], b[lo:]
    k, most = 0, min(len(a), len(b))
    while k < most and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b) <= edits
    if len(a) <= edits:
        return _small(a, b) <= edits
    # each edit changes two letter counts by one at most
    if np.abs(_letters(a) - _letters(b)).sum() > 2 * edits:
        return False
    width = 2 * edits + 2
    full = (1 << width) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down = (full << (width - edits - 1)) & full, 0
    distance, top, base = edits, 1 << (width - 1), edits + 1 - width
    row = 1 << (width - 2)
    # along the diagonal the distance never falls, and each step of the last row takes one off at most
    most = edits + len(b) - len(a) + edits
    for j, c in enumerate(b):
        p = places.get(c, 0)
        same = (p >> base if base >= 0 else p << -base) & full
        diagonal = (((same & up) + up) ^ up) | same | down
        plus = (down | ~(diagonal | up)) & full
        minus = diagonal & up
        if j < len(a) - edits:
            distance += not diagonal & top
            if distance > most:
                return False
        else:
            distance += bool(plus & row) - bool(minus & row)
            row >>= 1
        up = (minus | ~((diagonal & full) >> 1 | plus)) & full
        down = ((diagonal & full) >> 1) & plus
        base += 1
    return distance <= edits


def _small(a: str, b: str) -> int:
    """Edit distance by rows, for remainders no longer than the bound."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(last[j] + 1, new[-1] + 1, last[j - 1] + (x != y)))
        last = new
    return last[-1]


def allowed(length: int, tiers: Tiers) -> int:
    """Edits that a line of this length may have as the shorter one."""
    return next((edits for least, edits in reversed(tiers) if length >= least), 0)


def _common(points: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """Equal code points of each pair from places ``a`` and ``b`` on, forwards or backwards, ``most`` at most."""
    out = np.zeros(len(a), np.int64)
    left, at = np.flatnonzero(most > 0), np.arange(COLUMNS)
    while len(left):
        same = points.take(a[left, None] + step * at, mode="clip") == points.take(b[left, None] + step * at, mode="clip")
        same &= at < most[left, None]
        run = np.where(same.all(axis=1), COLUMNS, same.argmin(axis=1))
        out[left] += run
        left, at = left[run == COLUMNS], at + COLUMNS
    return out


def _bands(points: np.ndarray, a: np.ndarray, len_a: np.ndarray, b: np.ndarray, len_b: np.ndarray, edits: int) -> np.ndarray:
    """What ``within`` says, column by column for all pairs at once; an ``a`` is longer than ``edits`` and no longer than its ``b``."""
    width = 2 * edits + 2
    full, one, top = np.uint32((1 << width) - 1), np.uint32(1), np.uint32(width - 1)
    live = np.argsort(-len_b, kind="stable")
    a, len_a, b, len_b = a[live], len_a[live], b[live], len_b[live]
    up, down = np.full(len(a), (int(full) << (width - edits - 1)) & int(full), np.uint32), np.zeros(len(a), np.uint32)
    distance, most = np.full(len(a), edits), 2 * edits + len_b - len_a
    out = np.zeros(len(a), bool)
    j = 0
    while len(live):
        columns = min(COLUMNS, int(len_b[0]) - j)
        rows = np.arange(j - edits - 1, j + columns + edits)[:, None]
        x = points.take(a + rows, mode="clip")
        x[(rows < 0) | (rows >= len_a)] = _NONE
        y = points.take(b + np.arange(j, j + columns)[:, None], mode="clip")
        same = np.zeros(y.shape, np.uint32)
        for r in range(width):
            same |= (x[r : r + columns] == y).astype(np.uint32) << np.uint32(r)
        steep = int(len_a.min()) - edits  # before it every pair follows its diagonal
        for s, n in zip(same, np.searchsorted(-len_b, -np.arange(j, j + columns)).tolist(), strict=True):
            s, u, d = s[:n], up[:n], down[:n]
            diagonal = (((s & u) + u) ^ u) | s | d
            plus, minus = (d | ~(diagonal | u)) & full, diagonal & u
            fall = (~diagonal >> top) & one
            if j < steep:
                distance[:n] += fall
            else:
                row = len_a[:n] + edits - j
                at = np.maximum(np.minimum(row, 2 * edits), 0).astype(np.uint32)
                distance[:n] += np.where(row > 2 * edits, fall, (plus >> at & one).astype(np.int64) - (minus >> at & one))
            half = (diagonal & full) >> one
            up[:n], down[:n] = (minus | ~(half | plus)) & full, half & plus
            j += 1
        done = len_b <= j
        out[live[done]] = distance[done] <= edits
        stay = ~done & (distance <= most)
        live, a, len_a, b, len_b, up, down, distance, most = (v[stay] for v in (live, a, len_a, b, len_b, up, down, distance, most))
    return out


def near(points: np.ndarray, a: np.ndarray, len_a: np.ndarray, b: np.ndarray, len_b: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Which pairs of ranges of ``points`` are within their bounds; an ``a`` is no longer than its ``b``."""
    skip = _common(points, a, b, len_a, 1)
    a, len_a, b, len_b = a + skip, len_a - skip, b + skip, len_b - skip
    skip = _common(points, a + len_a - 1, b + len_b - 1, len_a, -1)
    len_a, len_b = len_a - skip, len_b - skip
    out = len_b - len_a <= edits
    for k in np.unique(edits[out]).tolist():
        own = np.flatnonzero(out & (edits == k) & (len_a > 0))
        many = own[len_a[own] > k] if k <= MOST_EDITS else own[:0]
        if len(many) >= FEW:
            out[many] = _bands(points, a[many], len_a[many], b[many], len_b[many], k)
            own = np.setdiff1d(own, many)
        for i in own.tolist():
            x, y = (points[v[i] : v[i] + n[i]].tobytes().decode("utf-32-le", "surrogatepass") for v, n in ((a, len_a), (b, len_b)))
            out[i] = within(x, y, k)
    return out


def link(lines: list[str], cell: np.ndarray, block: np.ndarray, tiers: Tiers) -> list[tuple[int, int]]:
    """A spanning forest of the links inside each cell (numbers, ascending); in a cell of two blocks, across them only.

    All cells go together: round ``d`` pairs each line with the ``d``-th longer one of its cell, unless the rounds before have
    connected them, and what letter counts leave is compared in lots of ``PAIRS``.
    """
    n, size, cell, of = len(lines), np.array([len(x) for x in lines]), np.asarray(cell), np.asarray(block)
    heads = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
    two = np.repeat(np.minimum.reduceat(of, heads) != np.maximum.reduceat(of, heads), np.diff(heads, append=n))
    order = np.lexsort((size, cell))
    size, cell, of, two = size[order], cell[order], of[order], two[order]
    points = np.frombuffer("".join([lines[i] for i in order.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = np.cumsum(size)
    start = stop - size
    most = np.array([allowed(x, tiers) for x in size.tolist()])
    place = (cell - cell[0]) * (size.max() + most.max() + 1) + size
    end = np.searchsorted(place, place + most, "right")  # a line's partners among the longer ones
    letters = np.zeros((n, 64), np.int32)
    lo = 0
    while lo < n:  # a lot of lines, or one that is longer than that
        hi = max(lo + 1, int(np.searchsorted(stop, start[lo] + LOT, "right")))
        counts = np.bincount(np.repeat(np.arange(hi - lo) * 64, size[lo:hi]) + (points[start[lo] : stop[hi - 1]] & 63), minlength=64 * (hi - lo))
        letters[lo:hi] = counts.reshape(-1, 64)
        lo = hi
    component = np.arange(n)
    edges: list[tuple[int, int]] = []

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        apart = component[i] != component[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return
        good = near(points, start[i], size[i], start[j], size[j], most[i])
        for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True):
            if component[x] != component[y]:
                component[component == component[y]] = component[x]
                edges.append((int(order[x]), int(order[y])))

    open_, waiting, lot = np.flatnonzero(end > np.arange(n) + 1), 0, []
    d = 1
    while len(open_):
        i, j = open_, open_ + d
        good = (component[i] != component[j]) & (~two[i] | (of[i] != of[j]))
        i, j = i[good], j[good]
        # each edit changes two letter counts by one at most
        good = np.abs(letters[i] - letters[j]).sum(axis=1) <= 2 * most[i]
        lot.append((i[good], j[good]))
        waiting += int(good.sum())
        if waiting >= PAIRS:
            compare(*map(np.concatenate, zip(*lot, strict=True)))
            waiting, lot = 0, []
        d += 1
        open_ = open_[open_ + d < end[open_]]
    if waiting:
        compare(*map(np.concatenate, zip(*lot, strict=True)))
    return edges


def _verify(tiers: Tiers):
    """Rows (bucket, cell_i, cell_j, own, h1, h2, line), cell by cell, to edges; small cells are compared together."""

    def edges(cells: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(cells)
        found = link(rows.column(6).to_pylist(), np.repeat(np.arange(len(cells)), [c.num_rows for c in cells]), rows.column(3).to_numpy(), tiers)
        if found:
            h1, h2 = rows.column(4).to_numpy(), rows.column(5).to_numpy()
            i, j = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[i], h2[i], h1[j], h2[j])], names=["a", "a2", "b", "b2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[pa.RecordBatch] = []
        lines = size = 0
        for cell in runs(batches, 3):
            if cell.num_rows < 2:
                continue
            cells.append(cell)
            lines += cell.num_rows
            size += pc.sum(pc.binary_length(cell.column(6))).as_py()
            if lines >= 4 * BLOCK or size >= 2 * LOT:
                yield from edges(cells)
                cells, lines, size = [], 0, 0
        if cells:
            yield from edges(cells)

    return tidy(run)


def _wanted(shared, min_chars: int):
    """Rows (text) to (h1, h2, line) of the lines that may be candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Bitmap = shared.value
        for batch in batches:
            for _, _, data, offsets in textvec.chunks(batch.column(0), SCANNED):
                # a line of enough characters has as many bytes at least; shorter ones are no candidates
                raw, stops = data.tobytes(), np.union1d(np.flatnonzero(data == 10), offsets[1:])
                starts = np.concatenate([[0], stops[:-1] + (data[np.minimum(stops[:-1], len(data) - 1)] == 10)]) if len(data) else stops[:0]
                long = np.flatnonzero(stops[: len(starts)] - starts >= min_chars)
                if not len(long):
                    continue
                bounds = list(zip(starts[long].tolist(), stops[long].tolist(), strict=True))
                h = identities(raw, bounds)
                hit = np.flatnonzero(own.may(np.ascontiguousarray(h[:, 0])))
                hit = hit[np.unique(h[hit, 0], return_index=True)[1]]
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in map(bounds.__getitem__, hit.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h[hit, 0]), pa.array(h[hit, 1]), pa.array(texts, pa.string())], names=["h1", "h2", "line"])

    return tidy(run)


def _row(doc_id, text):
    """A row's identity besides its doc_id."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def near_lines(given: DataFrame, lines: DataFrame, tiers: Tiers) -> DataFrame:
    """(h1, h2, component) of the lines that have a near one."""
    spark = given.sparkSession
    keys = lines.where("size(keys) > 0").select(F.explode("keys").alias("key"), "h1").select(F.expr("key & -2").alias("bucket"), (F.col("key") % 2 == 0).alias("stored"), "h1")
    # a common line gives its keys once a chunk, and a common key has many lines: both are partial aggregates
    span = keys.groupBy("bucket").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.max("stored").alias("stored"))
    shared = cut(span.where("stored AND low < high").select("bucket"))
    met = cut(keys.select("bucket", "h1").join(shared, "bucket").distinct())
    # near lines share most of their segments: of keys with the same lines one is enough
    sets = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h1").alias("x"), F.bit_xor(F.xxhash64("h1")).alias("y")).where("n > 1")
    kept = cut(sets.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("_blocks")))
    members = cut(met.join(kept, "bucket").withColumn("own", F.pmod(F.xxhash64("h1"), F.col("_blocks")).cast("int")))
    bits = spark.sparkContext.broadcast(bitmap(members.select("h1"), members.count()))  # of bounded size
    texts = given.select("text").mapInArrow(_wanted(bits, tiers[0][0]), "h1 long, h2 long, line string").dropDuplicates(["h1", "h2"])
    dealt = members.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("bucket", F.least("own", "_other").alias("cell_i"), F.greatest("own", "_other").alias("cell_j"), "own", "h1")
    cells = dealt.join(texts, "h1").select("bucket", "cell_i", "cell_j", "own", "h1", "h2", "line")
    cells = cells.repartition("bucket", "cell_i", "cell_j").sortWithinPartitions("bucket", "cell_i", "cell_j")
    edges = cut(cells.mapInArrow(_verify(tiers), "a long, a2 long, b long, b2 long"))
    nodes = edges.select(F.col("a").alias("h1"), F.col("a2").alias("h2")).unionAll(edges.select(F.col("b").alias("h1"), F.col("b2").alias("h2"))).distinct()
    linked = components(edges)
    return nodes.join(linked, F.col("h1") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "h1").alias("component"))


def repeated(docs: DataFrame, tiers: Tiers = TIERS, exact_chars: int | None = None) -> DataFrame:
    """doc_id, row and drops: positions of the lines to take out, with near (whether the first is another text)."""
    ready(docs.sparkSession)
    given = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), _row(F.col("doc_id").cast("long"), F.col("text")).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    lines = cut(given.mapInArrow(_scan(tuple(tiers), tiers[0][0] if exact_chars is None else exact_chars), _LINES))
    place = F.struct("doc_id", "row", "pos")
    firsts = cut(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")))

    # near lines share the first occurrence of their component
    near = near_lines(given, lines, tuple(tiers)).join(firsts, ["h1", "h2"])
    near = cut(near.select("component", "h1", "h2", "first"))
    shared = near.groupBy("component").agg(F.min("first").alias("start"))
    near_firsts = near.join(shared, "component").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "start")
    start = cut(
        firsts.join(near_firsts, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
        .where("n > 1 OR start IS NOT NULL")
        .select("h1", "h2", F.coalesce("start", "first").alias("start"), F.coalesce(F.col("start") != F.col("first"), F.lit(False)).alias("near"))
    )
    drops = lines.select("doc_id", "row", "pos", "h1", "h2").join(start, ["h1", "h2"]).where(F.struct("doc_id", "row", "pos") != F.col("start"))
    return cut(drops.groupBy("doc_id", "row").agg(F.collect_set(F.struct("pos", "near")).alias("drops")))


def dedup_lines(docs: DataFrame, tiers: Tiers = TIERS, counts: tuple[str, str, str] = ("_lines", "_dropped", "_near"), exact_chars: int | None = None) -> DataFrame:
    """Rows with their lines deduplicated in text, and three columns more: all lines, lines taken out, of these near ones.

    ``counts`` has to name columns that the table lacks (else a ValueError)."""
    spark = docs.sparkSession
    textvec.unused(docs.columns, *counts)
    key, gone_lines, row, other = textvec.fresh(docs.columns, "_key", "_drops", "_row", "_other")
    drops = repeated(docs, tiers, exact_chars).select(F.col("doc_id").alias(key), F.col("row").alias(other), F.col("drops").alias(gone_lines))
    bits = spark.sparkContext.broadcast(bitmap(drops.select(other), drops.count()))  # of bounded size
    marked = docs.withColumn(row, _row(F.col("doc_id").cast("long"), F.col("text")))
    # rows that lose nothing needn't move
    hit = marked.mapInArrow(through(bits, True), marked.schema).join(drops, (F.col("doc_id") == F.col(key)) & (F.col(row) == F.col(other)), "left").select(*docs.columns, gone_lines)
    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in counts)])
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, count, gone, close = [], [], [], []
            for text, drop in zip(batch.column(place), batch.column(batch.num_columns - 1), strict=True):
                text, drop = text.as_py(), drop.as_py() or ()
                own = (text or "").split("\n")
                out = {d["pos"] for d in drop}
                texts.append("\n".join([x for i, x in enumerate(own) if i not in out]) if out else text)
                count.append(len(own))
                gone.append(len(out))
                close.append(sum(d["near"] for d in drop))
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (count, gone, close))], names=schema.names)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in through(bits, False)(batches):
            columns = batch.columns[:-1]
            n = pc.add(pc.count_substring(pc.fill_null(columns[place], ""), "\n"), 1).cast(pa.int64())
            zero = pa.array(np.zeros(batch.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([*columns, n, zero, zero], names=schema.names)

    return hit.mapInArrow(tidy(run), schema).unionAll(marked.mapInArrow(tidy(rest), schema))


def drop_lines(docs: DataFrame, tiers: Tiers = TIERS, exact_chars: int | None = None) -> DataFrame:
    """Documents with their lines deduplicated, without those that lost all; n_chars, if there, follows the text."""
    names = textvec.fresh(docs.columns, "_lines", "_dropped", "_near")
    dropped = F.col(names[1])
    out = dedup_lines(docs, tiers, tuple(names), exact_chars).where((dropped == 0) | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(dropped > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), exact_chars=EXACT_CHARS)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.col("_near").alias("n_near"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
