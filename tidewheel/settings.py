"""Numerical settings. Passed to operators, since executors don't see changes of driver globals."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """``exclusion_divisor``: a self-join skips |i - j| <= ceil(m / divisor); infinity leaves only the window itself out.

    ``snap``: squared distances (p-th powers) below it count as 0. ``block``: windows of a side of a join tile.
    """

    exclusion_divisor: float = 4.0
    snap: float = 1e-14
    block: int = 8192

    def zone(self, m: int) -> int:
        return 0 if math.isinf(self.exclusion_divisor) else math.ceil(m / self.exclusion_divisor)


DEFAULT = Settings()


@dataclass(frozen=True)
class Metric:
    """z-normalised Euclidean distance, or Minkowski distance of raw values where ``p`` is given."""

    p: float | None = None

    @property
    def normalized(self) -> bool:
        return self.p is None


ZNORM = Metric()


def metric_of(normalize: bool = True, p: float = 2.0) -> Metric:
    return ZNORM if normalize else Metric(float(p))


def check_window(m: int, n: int) -> None:
    """A window has at least 3 points and fits the series."""
    if m <= 2:
        raise ValueError("windows must have at least 3 points")
    if m > n:
        raise ValueError(f"a window of {m} points is longer than the series of {n}")


def check_arguments(m: int, k: int = 1, metric: Metric = ZNORM, percentage: float = 1.0) -> None:
    """Windows of 3 points or more, at least one neighbour, p of 1 or more, a share in (0, 1]."""
    check_window(m, m)
    if k < 1:
        raise ValueError("at least one neighbour has to be asked for")
    if metric.p is not None and metric.p < 1:
        raise ValueError("p has to be 1 or more")
    if not 0 < percentage <= 1:
        raise ValueError("a share lies above 0 and is 1 at most")


def largest_window(n: int, divisor: float = 4.0) -> int:
    """The largest window with which the middle of a series of ``n`` points has a neighbour outside its zone."""
    return int(n - math.floor((n + divisor - 1) // (divisor + 1)) - 1)
