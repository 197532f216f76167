"""Spectra of scatter matrices kept up to date by rank-one changes.

A spectrum holds the count and mean of the rows it has seen and the eigenvalues and eigenvectors of
their centred scatter. A new row changes the scatter by one outer product. In the basis of the
eigenvectors that is a diagonal matrix plus ``rho z z'``: parts of z that vanish, and all but one of
each group of equal eigenvalues, are deflated; the new eigenvalues of the rest are the roots of the
secular equation, one between each two old ones; the new vectors come from the z that has exactly
those roots, so they are orthogonal whatever the distance of the roots.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
STEPS = 100


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z^2 / (d - x))`` for rising distinct ``d``, and ``d[i] - root[j]``.

    A root is found as its distance from the nearer end of its interval, so that the differences are
    exact to rounding. Steps match the two ends' poles; one that leaves the bracket is a bisection.
    """
    k = len(d)
    weight = rho * z * z
    if k == 1:
        return d + weight, -weight[:, None]
    upper = np.append(d[1:], d[-1] + weight.sum())
    width = upper - d
    below = np.tri(k, dtype=bool)  # poles up to the root's own interval, by root and pole
    middle = d + width / 2
    at_middle = 1 + (weight / (d - middle[:, None])).sum(axis=1)
    right = (at_middle < 0) & (np.arange(k) < k - 1)
    origin = np.where(right, upper, d)
    pole = d - origin[:, None]
    low, high = np.where(right, -width / 2, 0.0), np.where(right, 0.0, width / 2)
    last = k - 1
    if at_middle[last] < 0:
        low[last], high[last] = width[last] / 2, width[last]
    else:
        high[last] = width[last] / 2
    own, next_ = d - origin, upper - origin
    next_[last] = 2 * width[last]  # no pole above the last root; one far off, without weight
    at = (low + high) / 2
    for _ in range(STEPS):
        parts = weight / (pole - at[:, None])
        value = 1 + parts.sum(axis=1)
        slopes = parts / (pole - at[:, None])
        left_slope = np.where(below, slopes, 0.0).sum(axis=1)
        right_slope = slopes.sum(axis=1) - left_slope
        done = np.abs(value) <= 2 * EPS * k * (1 + np.abs(parts).sum(axis=1))
        done |= high - low <= 2 * EPS * np.abs(at)
        if done.all():
            break
        low, high = np.where(value < 0, at, low), np.where(value < 0, high, at)
        to_own, to_next = own - at, next_ - at
        c = value - to_own * left_slope - to_next * right_slope
        a = (to_own + to_next) * value - to_own * to_next * (left_slope + right_slope)
        b = to_own * to_next * value
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        moved = at + step
        # Only points strictly inside the bracket are taken.
        inside = (moved > low) & (moved < high)
        at = np.where(done, at, np.where(inside, moved, (low + high) / 2))
    return origin + at, (pole - at[:, None]).T


def rank_one(values: np.ndarray, vectors: np.ndarray, change: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors after ``weight * change change'`` has been added."""
    z = vectors.T @ change
    norm = float(np.sqrt(z @ z))
    rho = weight * norm * norm
    if not rho > 0:
        return values, vectors
    z = z / norm
    vectors = vectors.copy()
    least = 8 * EPS * max(float(values[-1]), rho)
    # Among equal eigenvalues any basis will do: one in which a single vector has all of z.
    close = np.append(np.diff(values) <= least, False)
    if close.any():
        starts = np.flatnonzero(close & ~np.append(False, close[:-1]))
        ends = np.flatnonzero(~close & np.append(False, close[:-1])) + 1
        for a, b in zip(starts.tolist(), ends.tolist()):
            part = z[a:b].copy()
            length = float(np.sqrt(part @ part))
            mirror = part.copy()
            mirror[-1] += length if part[-1] >= 0 else -length
            square = float(mirror @ mirror)
            if square > 0:
                vectors[:, a:b] -= np.outer(vectors[:, a:b] @ mirror, (2 / square) * mirror)
                z[a:b] = 0.0
                z[b - 1] = -length if part[-1] >= 0 else length
    active = np.flatnonzero(rho * np.abs(z) > least)
    if not len(active):
        return values, vectors
    d, part = values[active], z[active]
    roots, away = secular_roots(d, part, rho)
    # The z whose secular equation has exactly these roots.
    gaps = d[None, :] - d[:, None]
    np.fill_diagonal(gaps, 1.0)
    exact = np.sqrt(np.abs(np.prod(-away / gaps, axis=1) / rho))
    exact = np.where(part < 0, -exact, exact)
    turn = exact[:, None] / away
    turn /= np.sqrt((turn * turn).sum(axis=0))
    vectors[:, active] = vectors[:, active] @ turn
    values = values.copy()
    values[active] = roots
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, mean, eigenvalues and eigenvectors of the centred scatter of rows."""

    def __init__(self, size: int):
        self.n, self.mean = 0, np.zeros(size)
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def _shift(self, n: int, mean: np.ndarray) -> None:
        """Join with ``n`` rows of the given mean, whose own scatter is added besides."""
        if self.n:
            self._change(mean - self.mean, self.n * n / (self.n + n))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def _change(self, row: np.ndarray, weight: float = 1.0) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, row, weight)

    def add_rows(self, rows: np.ndarray) -> None:
        """Rows as centred rank-one changes. More rows than columns are turned first, by an orthogonal
        matrix from the left, into as many rows as columns with the same scatter."""
        if not len(rows):
            return
        mean = rows.mean(axis=0)
        centred = rows - mean
        if len(centred) > centred.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        for row in centred:
            self._change(row)
        self._shift(len(rows), mean)

    def add(self, other: Spectrum) -> None:
        """Another spectrum, by one rank-one change for each of its eigenvectors."""
        if not other.n:
            return
        for value, vector in zip(other.values[::-1], other.vectors.T[::-1]):
            if value > 0:
                self._change(vector, float(value))
        self._shift(other.n, other.mean)
