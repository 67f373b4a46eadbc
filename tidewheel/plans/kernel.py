"""Numpy kernels of the nearest-neighbour join: distances between two blocks of windows, and their best pairs.

A tile is walked row by row. The row of window i against all columns follows from the row of window i - 1, for windows
(i, j) and (i - 1, j - 1) differ by one point at either end: covariances (z-normalised) or sums of powers (Minkowski) get
two products added, whatever the windows' length. Every ``RESTART`` rows (every m rows of longer windows) a row is
computed afresh, so that rounding doesn't build up.

What a row says is only used to name candidates: all columns within the rounding's bound of the row's best. Those pairs'
distances are then taken from the difference of the two windows, which keeps small distances exact, and among equally
near windows the smallest position wins. Windows so quiet beside the loudest of their block that the bound would name
too many are compared directly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from tidewheel.settings import Metric

#: Correlations this close to a row's best are ties.
TIE = 1e-13
#: Decimals to which distances are compared between blocks; the summing order decides beyond them.
DIGITS = 9
#: Rows after which a row is computed afresh.
RESTART = 512
#: Rows whose steps are taken as one product.
TOGETHER = 16
#: Largest bound of a correlation's rounding that candidates may have.
LOOSE = 1e-8
#: Points of windows that are held at a time where windows are taken whole: they stay in a core's cache.
HELD = 1 << 16
EPS = float(np.finfo(float).eps)


@dataclass
class Windows:
    """Windows of a stretch of a series, ready for distances. ``lo`` is the position of the first."""

    lo: int
    m: int
    values: np.ndarray  # missing as 0
    finite: np.ndarray
    const: np.ndarray
    metric: Metric

    def __len__(self) -> int:
        return len(self.finite)

    @property
    def raw(self) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.values, self.m)

    @cached_property
    def means(self) -> np.ndarray:
        return self.raw.mean(axis=1)

    @cached_property
    def scale(self) -> np.ndarray:
        """1 over a window's distance from its mean; 0 of constant windows and those with missing values."""
        length = np.zeros(len(self))
        for at in self._chunks(len(self)):
            length[at] = np.sqrt(((self.raw[at] - self.means[at, None]) ** 2).sum(axis=1))
        return np.where(self.const | ~self.finite | (length == 0), 0.0, 1 / np.where(length > 0, length, 1.0))

    @cached_property
    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Half the difference of the point that comes and the one that goes, and their sum without the means; 0 of the first."""
        half, both = np.zeros(len(self)), np.zeros(len(self))
        come, go = self.values[self.m :], self.values[: -self.m]
        half[1:] = (come - go) / 2
        both[1:] = (come - self.means[1:]) + (go - self.means[:-1])
        return half, both

    def _chunks(self, n: int) -> Iterator[slice]:
        size = max(1, HELD // self.m)
        for at in range(0, n, size):
            yield slice(at, min(n, at + size))

    def unit(self, at: np.ndarray | slice) -> np.ndarray:
        """Windows z-normalised to length 1; constant ones are 0."""
        out = self.raw[at] - self.means[at, None]
        out *= self.scale[at, None]
        return out


def prepare(values: np.ndarray, m: int, metric: Metric, lo: int = 0, constant: np.ndarray | Callable | None = None) -> Windows:
    """``constant``: flags that replace the test for constant windows, or a function of (values, m) that gives them."""
    values = np.asarray(values, np.float64)
    missing = ~np.isfinite(values)
    clean = np.where(missing, 0.0, values)
    before = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    gone = before(missing)
    finite = gone[m:] == gone[:-m]
    if constant is None:
        changes = before(clean[1:] != clean[:-1])
        const = changes[m - 1 :] == changes[: len(finite)]
    else:
        const = np.asarray(constant(np.where(missing, np.nan, values), m) if callable(constant) else constant, bool)
    if metric.normalized and not missing.all():
        # distances don't depend on it, rounding does
        clean = np.where(missing, 0.0, clean - np.median(clean[~missing]))
    return Windows(lo, m, clean, finite, const & finite, metric)


def similarity(a: Windows, b: Windows, rows: slice, cols: slice | np.ndarray) -> np.ndarray:
    """Larger is nearer, -inf where there is no distance: correlations, or minus the p-th power of the distance. Directly, at
    a cost that grows with the windows."""
    if a.metric.normalized:
        rho = a.unit(rows) @ b.unit(cols).T
        ca, cb = a.const[rows], b.const[cols]
        if ca.any() or cb.any():
            rho[ca] = 0.5
            rho[:, cb] = 0.5
            rho[np.ix_(ca, cb)] = 1.0
    else:
        p = a.metric.p
        x, y = a.raw[rows], b.raw[cols]
        if p == 2:
            rho = 2 * (x @ y.T) - (x**2).sum(axis=1)[:, None] - (y**2).sum(axis=1)[None, :]
        else:
            rho = np.zeros((len(x), len(y)))
            for k in range(a.m):
                rho -= np.abs(x[:, k][:, None] - y[:, k][None, :]) ** p
    fa, fb = a.finite[rows], b.finite[cols]
    if not fa.all():
        rho[~fa] = -np.inf
    if not fb.all():
        rho[:, ~fb] = -np.inf
    return rho


def exact(a: Windows, b: Windows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs (i, j) of local positions; inf where j is negative or a window has a missing value."""
    m, ok = a.m, j >= 0
    jj = np.where(ok, j, 0)
    ok = ok & a.finite[i] & b.finite[jj]
    d = np.empty(len(i))
    for at in a._chunks(len(i)):
        if a.metric.normalized:
            difference = a.unit(i[at])
            difference -= b.unit(jj[at])
            d[at] = np.einsum("ij,ij->i", difference, difference)
        else:
            d[at] = (np.abs(a.raw[i[at]] - b.raw[jj[at]]) ** a.metric.p).sum(axis=1)
    if a.metric.normalized:
        d = np.sqrt(d * m)
        ca, cb = a.const[i], b.const[jj]
        d = np.where(ca & cb, 0.0, np.where(ca | cb, np.sqrt(m), d))
        d = np.where(d < 1e-7, 0.0, d)
    else:
        d = np.where(d < 1e-14, 0.0, d) ** (1 / a.metric.p)
    return np.where(ok, d, np.inf)


def full(a: Windows, b: Windows) -> np.ndarray:
    """All distances, for small blocks."""
    out = np.empty((len(a), len(b)))
    every = np.arange(len(a))
    for j in range(len(b)):
        out[:, j] = exact(a, b, every, np.full(len(a), j))
    return out


class Best:
    """The k nearest of each row so far: (n, k) distances and positions, merged block by block."""

    def __init__(self, n: int, k: int):
        self.d = np.full((n, k), np.inf)
        self.j = np.full((n, k), -1, np.int64)

    def offer(self, at: slice | np.ndarray, d: np.ndarray, j: np.ndarray) -> None:
        """Candidates (rows, any number); a position offered twice counts once."""
        k = self.d.shape[1]
        if k == 1 and d.shape[1] == 1:
            own_d, own_j = self.d[at, 0], self.j[at, 0]
            a, b = np.round(d[:, 0], DIGITS), np.round(own_d, DIGITS)
            new = (j[:, 0] >= 0) & ((a < b) | ((a == b) & ((j[:, 0] < own_j) | (own_j < 0))))
            self.d[at, 0] = np.where(new, d[:, 0], own_d)
            self.j[at, 0] = np.where(new, j[:, 0], own_j)
            return
        d = np.concatenate([self.d[at], d], axis=1)
        j = np.concatenate([self.j[at], j], axis=1)
        d = np.where(j < 0, np.inf, d)
        order = np.lexsort((j, np.round(d, DIGITS)), axis=1)
        d, j = np.take_along_axis(d, order, 1), np.take_along_axis(j, order, 1)
        again = np.zeros_like(j, bool)
        for c in range(1, j.shape[1]):
            again[:, c] = (j[:, c][:, None] == j[:, :c]).any(axis=1)
        d, j = np.where(again, np.inf, d), np.where(again, -1, j)
        order = np.lexsort((j, np.round(d, DIGITS)), axis=1)[:, :k]
        self.d[at], self.j[at] = np.take_along_axis(d, order, 1), np.take_along_axis(j, order, 1)
        self.j[at] = np.where(np.isinf(self.d[at]), -1, self.j[at])

    def offer_pairs(self, i: np.ndarray, d: np.ndarray, j: np.ndarray) -> None:
        """Candidates as pairs of a row and a position."""
        there = np.isfinite(d)
        i, d, j = i[there], d[there], j[there]
        order = np.lexsort((j, np.round(d, DIGITS), i))
        i, d, j = i[order], d[order], j[order]
        rows, first, count = np.unique(i, return_index=True, return_counts=True)
        for n in range(min(self.d.shape[1], int(count.max(initial=0)))):
            some = count > n
            self.offer(rows[some], d[first[some] + n][:, None], j[first[some] + n][:, None])


#: Points of a window from which sliding products are taken by Fourier transforms.
FOURIER = 256


def _correlate(values: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Products of a window with each stretch of its length; by blocks of overlapping stretches for long windows."""
    m = len(window)
    if m < FOURIER:
        return np.correlate(values, window, "valid")
    size = 1 << max(4 * m, 1 << 12).bit_length()
    step = size - m + 1
    turned = np.conj(np.fft.rfft(window, size))
    out = np.empty(len(values) - m + 1)
    for at in range(0, len(out), step):
        n = min(step, len(out) - at)
        out[at : at + n] = np.fft.irfft(np.fft.rfft(values[at : at + size], size) * turned, size)[:n]
    return out


class Rows:
    """Similarities of each window of ``a`` to a range of windows of ``b``, row by row, with a bound of their rounding.

    ``bounds``: of a row's local position, the first column and the one behind the last; neither may fall, and neither may
    rise by more than 1 a row.
    """

    def __init__(self, a: Windows, b: Windows, bounds: Callable[[int], tuple[int, int]]):
        self.a, self.b, self.bounds = a, b, bounds
        self.normalized = a.metric.normalized
        self.every = max(RESTART, a.m)
        self.masked = ~b.finite if not b.finite.all() else None
        self.flat = b.const if self.normalized and b.const.any() else None
        error = self._error()
        if self.normalized:
            # windows up to 1 / loudest from their mean have bounds of LOOSE at most with each other
            loudest = np.sqrt(LOOSE / error) if error > 0 else np.inf
            self.poor_a, poor = a.scale > loudest, b.scale > loudest
            self.poor = np.flatnonzero(poor) if poor.any() else None
            self.direct = a.scale * (error * float(b.scale[~poor].max(initial=0.0))) + TIE  # a row's bound
        else:
            self.poor_a, self.poor = np.zeros(len(a), bool), None
            self.direct = np.full(len(a), error)

    def _error(self) -> float:
        """Of a covariance, or of a sum of powers."""
        a, b, m = self.a, self.b, self.a.m
        top = lambda x: float(np.abs(x).max(initial=0.0))
        high_a, high_b = top(a.values), top(b.values)
        if self.normalized:
            (half_a, both_a), (half_b, both_b) = a.steps, b.steps
            loud = lambda w: float(1 / w.scale[w.scale > 0].min(initial=np.inf))
            # transforms carry the rounding of all points that they take together
            reach = m if m < FOURIER else 16 * m
            fresh = 8 * reach**0.5 * max(loud(a) * high_b, loud(b) * high_a)
            added = high_a * top(both_b) + high_b * top(both_a) + 2 * top(half_a) * top(both_b) + 2 * top(half_b) * top(both_a) + loud(a) * loud(b)
        else:
            fresh = added = 4 * (high_a + high_b) ** a.metric.p
            fresh *= 4 * m if a.metric.p == 2 else m**0.5
        return 2 * EPS * (fresh + added * self.every / 4)

    def _power(self, x: np.ndarray) -> np.ndarray:
        p = self.a.metric.p
        if p == 2:
            x *= x
        else:
            np.abs(x, out=x)
            if p != 1:
                np.power(x, p, out=x)
        return x

    def _fresh(self, r: int, lo: int, hi: int) -> np.ndarray:
        """Covariances or sums of powers of row r, for columns lo to hi."""
        a, b, m = self.a, self.b, self.a.m
        x, y = a.values[r : r + m], b.values[lo : hi + m - 1]
        if self.normalized:
            return _correlate(y, x - a.means[r])
        if a.metric.p == 2:
            squares = np.concatenate([[0.0], np.cumsum(y * y)])
            return (x @ x + squares[m:] - squares[:-m]) - 2 * _correlate(y, x)
        return self._sums(np.lib.stride_tricks.sliding_window_view(y, m), x)

    def _sums(self, windows: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(windows))
        for at in self.a._chunks(len(windows)):
            out[at] = self._power(windows[at] - x).sum(axis=1)
        return out

    def _first(self) -> np.ndarray:
        """The first column."""
        a, b, m = self.a, self.b, self.a.m
        y = b.values[:m]
        if self.normalized:
            return _correlate(a.values, y - b.means[0])
        if a.metric.p == 2:
            squares = np.concatenate([[0.0], np.cumsum(a.values * a.values)])
            return (y @ y + squares[m:] - squares[:-m]) - 2 * _correlate(a.values, y)
        return self._sums(a.raw, y)

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray, float]]:
        """(row, first column, similarities, bound) of each row that has columns; the array is used again."""
        a, b, m = self.a, self.b, self.a.m
        width = len(b)
        now, before, spare, out = (np.empty(width) for _ in range(4))
        first = self._first()
        if self.normalized:
            (half_a, both_a), (half_b, both_b) = a.steps, b.steps
            scale_a, scale_b = a.scale, b.scale
        else:
            xs, ys = a.values, b.values
        basis = np.stack([both_b, half_b]) if self.normalized else None
        added, start, left = None, 0, 0
        known = None  # the columns that ``before`` holds
        block = None  # poor columns of some rows
        for r in range(len(a)):
            lo, hi = self.bounds(r)
            hi = min(hi, width)
            if lo >= hi:
                known = None
                continue
            if known is None or r % self.every == 0:
                now[lo:hi] = self._fresh(r, lo, hi)
            else:
                c = max(lo, 1)
                if c < hi:
                    t, into = spare[c:hi], now[c:hi]
                    if self.normalized:
                        if added is None or r >= start + TOGETHER:
                            # what some rows add, as one product
                            start, left = r, lo
                            stop = min(len(a), r + TOGETHER)
                            right = min(width, self.bounds(stop - 1)[1])
                            added = np.stack([half_a[r:stop], both_a[r:stop]], axis=1) @ basis[:, left:right]
                        np.add(before[c - 1 : hi - 1], added[r - start, c - left : hi - left], out=into)
                    else:
                        np.subtract(ys[c + m - 1 : hi + m - 1], xs[r + m - 1], out=t)
                        np.add(before[c - 1 : hi - 1], self._power(t), out=into)
                        np.subtract(ys[c - 1 : hi - 1], xs[r - 1], out=t)
                        into -= self._power(t)
                if lo == 0:
                    now[0] = first[r]
            known = lo, hi
            now, before = before, now  # ``before`` is this row's from here on
            if not a.finite[r]:
                continue
            sim, bound = out[lo:hi], float(self.direct[r])
            if self.normalized:
                if a.const[r]:
                    sim[:] = 0.5
                    bound = 0.0
                elif self.poor_a[r]:
                    sim[:] = self._directly(r, lo, hi)
                    bound = TIE
                else:
                    np.multiply(before[lo:hi], scale_b[lo:hi], out=sim)
                    sim *= scale_a[r]
                    if self.poor is not None:
                        if block is None or r >= block[0].stop:
                            rows = slice(r, min(len(a), r + max(1, 8 * HELD // max(m, len(self.poor)))))
                            block = rows, self._block(rows)
                        at = np.searchsorted(self.poor, (lo, hi))
                        cols = self.poor[at[0] : at[1]]
                        sim[cols - lo] = block[1][r - block[0].start, at[0] : at[1]]
                if self.flat is not None:
                    sim[self.flat[lo:hi]] = 1.0 if a.const[r] else 0.5
            else:
                np.negative(before[lo:hi], out=sim)
            if self.masked is not None:
                sim[self.masked[lo:hi]] = -np.inf
            yield r, lo, sim, bound

    def diagonal(self, i: int, j: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, bounds) of the pairs (i, j), (i + 1, j + 1) and so on; the bound of a poor window's pair is infinite."""
        a, b, m = self.a, self.b, self.a.m
        out = np.empty(n)
        at_a, at_b = slice(i, i + n), slice(j, j + n)
        if self.normalized:
            (half_a, both_a), (half_b, both_b) = a.steps, b.steps
            added = half_a[at_a] * both_b[at_b]
            added += both_a[at_a] * half_b[at_b]
        else:
            # of each pair but the first, what comes less what goes
            come = self._power(a.values[i + m - 1 : i + n + m - 1] - b.values[j + m - 1 : j + n + m - 1])
            added = come.copy()
            added[1:] -= self._power(a.values[i : i + n - 1] - b.values[j : j + n - 1])
        for at in range(0, n, self.every):
            x, y = a.values[i + at : i + at + m], b.values[j + at : j + at + m]
            added[at] = (x - a.means[i + at]) @ y if self.normalized else self._power(x - y).sum()
            np.cumsum(added[at : at + self.every], out=out[at : at + self.every])
        bounds = self.direct[at_a].copy()
        if self.normalized:
            out *= a.scale[at_a]
            out *= b.scale[at_b]
            poor = self.poor_a[at_a].copy()
            if self.poor is not None:
                poor |= np.isin(np.arange(j, j + n), self.poor)
            bounds[poor] = np.inf
            flat_a, flat_b = a.const[at_a], b.const[at_b]
            flat = flat_a | flat_b
            out[flat] = np.where(flat_a & flat_b, 1.0, 0.5)[flat]
            bounds[flat] = 0.0
        else:
            np.negative(out, out=out)
        out[~(a.finite[at_a] & b.finite[at_b])] = -np.inf
        return out, bounds

    def _block(self, rows: slice) -> np.ndarray:
        """Correlations of some rows with the poor columns."""
        x = self.a.unit(rows)
        return np.concatenate([x @ self.b.unit(self.poor[at]).T for at in self.a._chunks(len(self.poor))], axis=1)

    def _directly(self, r: int, lo: int, hi: int) -> np.ndarray:
        x = self.a.unit(slice(r, r + 1))[0]
        return np.concatenate([self.b.unit(slice(lo + at.start, lo + at.stop)) @ x for at in self.a._chunks(hi - lo)])


def distances_to(query: Windows, w: Windows) -> np.ndarray:
    """Distances of the one window of ``query`` to each of ``w``; inf where a value is missing."""
    out = np.full(len(w), np.inf)
    for _, lo, sim, bound in Rows(query, w, lambda r: (0, len(w))):
        at = np.flatnonzero(sim > -np.inf)
        if query.metric.normalized:
            square = 2 * query.m * np.maximum(0.0, 1 - sim[at])
            bound = 2 * query.m * bound
            out[at + lo] = np.sqrt(square)
        else:
            square = np.maximum(0.0, -sim[at])
            out[at + lo] = square ** (1 / query.metric.p)
        # what the rounding may have moved in the ninth digit is measured
        loose = at[square * 1e-9 <= bound]
        out[loose + lo] = exact(query, w, np.zeros(len(loose), np.int64), loose + lo)
    return out


class Candidates:
    """Pairs that may be a row's k nearest: measured when there are many, and at the end."""

    MANY = 1 << 16

    def __init__(self, a: Windows, b: Windows, found: tuple[Best, ...], back: tuple[Best, ...] = ()):
        """``found``: of rows of ``a``; ``back``: of ``b``, for pairs that are given the other way round."""
        self.a, self.b, self.found, self.back = a, b, found, back
        self.clear()

    def clear(self) -> None:
        self.i: list[np.ndarray] = []
        self.j: list[np.ndarray] = []
        self.size = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.i.append(i)
        self.j.append(j)
        self.size += len(i)

    def measure(self, keep: np.ndarray | None = None) -> None:
        """``keep``: of the pairs in the order given, those that still matter."""
        if not self.size:
            return
        i, j = np.concatenate(self.i), np.concatenate(self.j)
        if keep is not None:
            i, j = i[keep], j[keep]
        d = exact(self.a, self.b, i, j)
        for best in self.found:
            best.offer_pairs(i, d, j + self.b.lo)
        for best in self.back:
            best.offer_pairs(j, d, i + self.a.lo)
        self.clear()


class Columns:
    """The rows that may be each column's nearest, as rows come by."""

    def __init__(self, a: Windows, b: Windows, back: tuple[Best, ...], slack: float):
        """``slack``: no row's bound is larger."""
        self.pairs = Candidates(a, b, (), back)
        self.slack = slack
        self.best = np.full(len(b), -np.inf)  # less the bound
        self.low = np.full(len(b), -np.inf)  # less the slack too
        self.bound: list[np.ndarray] = []

    def row(self, r: int, lo: int, sim: np.ndarray, bound: float) -> None:
        hit = np.flatnonzero(sim >= self.low[lo : lo + len(sim)])
        if not len(hit):
            return
        value = sim[hit]
        fine = (value > -np.inf) & (value + bound >= self.best[hit + lo])
        hit, value = hit[fine], value[fine]
        at = hit + lo
        self.best[at] = np.maximum(self.best[at], value - bound)
        self.low[at] = self.best[at] - self.slack
        self.bound.append(value + bound)
        self.pairs.add(np.full(len(at), r), at)
        if self.pairs.size > Candidates.MANY:
            self.prune()

    def prune(self, last: bool = False) -> None:
        """Drop pairs that a later one has beaten; measure the others if they are still many."""
        if not self.pairs.size:
            return
        i, j, top = (np.concatenate(x) for x in (self.pairs.i, self.pairs.j, self.bound))
        keep = top >= self.best[j]
        self.pairs.i, self.pairs.j, self.bound = [i[keep]], [j[keep]], [top[keep]]
        self.pairs.size = int(keep.sum())
        if last or self.pairs.size > Candidates.MANY // 2:
            self.pairs.measure()
            self.bound = []


def _row_candidates(sim: np.ndarray, bound: float, k: int, flat: np.ndarray | None, const: bool) -> np.ndarray:
    """Columns that may be among the k nearest of a row."""
    if k == 1:
        first = int(sim.argmax())
        top = sim[first]
        if top == -np.inf:
            return np.zeros(0, np.int64)
        if const:  # values are exact, ties go to the first
            return np.array([first])
        limit = top - 2 * bound
        if np.count_nonzero(sim >= limit) == 1:
            return np.array([first])
    else:
        if const:
            there = np.flatnonzero(sim > -np.inf)
            return there[np.argsort(-sim[there], kind="stable")[:k]]
        limit = np.partition(sim, len(sim) - min(k, len(sim)))[len(sim) - min(k, len(sim))] - 2 * bound
    found = np.flatnonzero((sim >= limit) & (sim > -np.inf))
    if flat is not None:  # constant windows are all as far
        even = flat[found]
        found = np.sort(np.concatenate([found[~even], found[even][:k]]))
    return found


@dataclass
class Found:
    """Best pairs of a side of a tile: the k nearest, and the nearest to the left and to the right."""

    near: Best
    left: Best
    right: Best

    @classmethod
    def of(cls, n: int, k: int) -> Found:
        return cls(Best(n, k), Best(n, 1), Best(n, 1))


def _nearest(a: Windows, b: Windows, k: int, found: tuple[Best, ...], bounds: Callable[[int], tuple[int, int]], back: tuple[Best, ...] = ()) -> None:
    """The k nearest columns of each row, and (k = 1) the nearest row of each column for ``back``."""
    pairs = Candidates(a, b, found)
    rows = Rows(a, b, bounds)
    columns = Columns(a, b, back, float(rows.direct[~rows.poor_a].max(initial=TIE))) if back else None
    for r, lo, sim, bound in rows:
        flat = rows.flat[lo : lo + len(sim)] if rows.flat is not None else None
        at = _row_candidates(sim, bound, k, flat, bool(a.const[r]) and a.metric.normalized)
        if len(at):
            pairs.add(np.full(len(at), r), at + lo)
            if pairs.size > Candidates.MANY:
                pairs.measure()
        if columns is not None:
            columns.row(r, lo, sim, bound)
    pairs.measure()
    if columns is not None:
        columns.prune(last=True)


def self_tile(a: Windows, b: Windows, zone: int, k: int) -> tuple[Found, Found]:
    """A tile of a self-join with a.lo <= b.lo: each pair i < j with j - i > zone is seen once, for both of its windows (twice
    for more than one neighbour: a column's k nearest take a walk of their own)."""
    of_a, of_b = Found.of(len(a), k), Found.of(len(b), k)
    gap = zone + 1 + a.lo - b.lo
    right = lambda r: (max(0, r + gap), len(b))
    if k == 1:
        _nearest(a, b, 1, (of_a.near, of_a.right), right, (of_b.near, of_b.left))
    else:
        _nearest(a, b, k, (of_a.near, of_a.right), right)
        _nearest(b, a, k, (of_b.near, of_b.left), lambda r: (0, max(0, min(len(a), r - gap + 1))))
    return of_a, of_b


def ab_tile(a: Windows, b: Windows, k: int) -> Found:
    """A tile of a join of two series, for the windows of ``a``."""
    found = Found.of(len(a), k)
    _nearest(a, b, k, (found.near,), lambda r: (0, len(b)))
    return found


def self_profile(values: np.ndarray, m: int, metric: Metric, zone: int, k: int = 1, constant=None) -> Found:
    """The whole profile of one series in memory."""
    w = prepare(values, m, metric, constant=constant)
    a, b = self_tile(w, w, zone, k)
    for name in ("near", "left", "right"):
        other = getattr(b, name)
        getattr(a, name).offer(slice(0, len(w)), other.d, other.j)
    return a


def ab_profile(x: np.ndarray, y: np.ndarray, m: int, metric: Metric, k: int = 1, constant_x=None, constant_y=None) -> Found:
    return ab_tile(prepare(x, m, metric, constant=constant_x), prepare(y, m, metric, constant=constant_y), k)
