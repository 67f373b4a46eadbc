"""Brute-force numpy versions, written from the definitions."""

import numpy as np


def distance(a, b, p=None):
    """z-normalised Euclidean distance, or Minkowski distance where p is given; inf with a missing value."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        return np.inf
    if p is not None:
        return float((np.abs(a - b) ** p).sum() ** (1 / p))
    ca, cb = a.max() == a.min(), b.max() == b.min()
    if ca or cb:
        return 0.0 if ca and cb else len(a) ** 0.5
    return float(np.sqrt((((a - a.mean()) / a.std() - (b - b.mean()) / b.std()) ** 2).sum()))


def matrix(x, y, m, p=None):
    x, y = np.asarray(x, float), np.asarray(y, float)
    return np.array([[distance(x[i : i + m], y[j : j + m], p) for j in range(len(y) - m + 1)] for i in range(len(x) - m + 1)])


def self_matrix(x, m, zone, p=None):
    d = matrix(x, x, m, p)
    i = np.arange(len(d))
    d[np.abs(i[:, None] - i[None, :]) <= zone] = np.inf
    return d


def nearest(d):
    """(distances, first positions or -1) of each row."""
    low = d.min(axis=1)
    return low, np.where(np.isinf(low), -1, d.argmin(axis=1))
