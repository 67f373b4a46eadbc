"""Distances between windows as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.settings import Metric


def squared_difference(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def znorm_distance(za: Column, zb: Column, ca: Column, cb: Column, fa: Column, fb: Column, m: int) -> Column:
    """Between z-normalised arrays with their constant and finite flags; NULL where there is none."""
    d = F.sqrt(squared_difference(za, zb))
    return F.when(fa & fb, F.when(ca & cb, 0.0).when(ca | cb, math.sqrt(m)).otherwise(F.when(d < 1e-7, 0.0).otherwise(d)))


def minkowski_distance(a: Column, b: Column, fa: Column, fb: Column, p: float) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(0.0), lambda s, x: s + x)
    return F.when(fa & fb, F.pow(F.when(total < 1e-14, 0.0).otherwise(total), F.lit(1 / p)))


def distance(metric: Metric, m: int, left: str = "x", right: str = "y") -> Column:
    """Between the windows ``left`` and ``right`` (columns a, z, is_const, is_finite of either)."""
    f = lambda side, c: F.col(f"{side}.{c}")
    if metric.normalized:
        return znorm_distance(f(left, "z"), f(right, "z"), f(left, "is_const"), f(right, "is_const"), f(left, "is_finite"), f(right, "is_finite"), m)
    return minkowski_distance(f(left, "a"), f(right, "a"), f(left, "is_finite"), f(right, "is_finite"), metric.p)
