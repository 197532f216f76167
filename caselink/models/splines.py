"""Natural cubic splines for integer covariates with few distinct values."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Spline:
    """Columns per distinct value, and the matrix of the roughness penalty on their coefficients."""

    basis: np.ndarray
    penalty: np.ndarray

    @property
    def rank(self) -> int:
        """Dimensions the penalty acts on: all but the straight line."""
        return max(self.basis.shape[1] - 1, 0)


def natural_spline(values: list[int], knots: int = 10) -> Spline:
    """One row per distinct value, orthonormal columns orthogonal to the constant.

    Knots lie at equally spaced ranks of the distinct values. The columns span the cubic splines
    that are linear beyond the outer knots, less the constant; the penalty is the integrated squared
    second derivative over the range of the data scaled to one.
    """
    x = np.asarray(values, dtype=float)
    if len(x) < 2:
        return Spline(np.empty((len(x), 0)), np.empty((0, 0)))
    x = (x - x.min()) / (x.max() - x.min())
    at = np.quantile(x, np.linspace(0, 1, min(knots, len(x))))
    count = len(at)

    def rise(point: np.ndarray, i: int, power: int) -> np.ndarray:
        """Truncated power from knot i, made to cancel beyond the last knot."""
        lower = np.clip(point - at[i], 0, None) ** power
        return (lower - np.clip(point - at[-1], 0, None) ** power) / (at[-1] - at[i])

    raw = np.column_stack([x, *[rise(x, i, 3) - rise(x, count - 2, 3) for i in range(count - 2)]])
    centred = raw - raw.mean(axis=0)
    basis, upper = np.linalg.qr(centred)
    scale = np.sqrt(len(x))

    # Second derivatives are straight between knots, so Simpson's rule integrates products exactly.
    def bend(point: np.ndarray) -> np.ndarray:
        curves = [6 * (rise(point, i, 1) - rise(point, count - 2, 1)) for i in range(count - 2)]
        return np.column_stack([np.zeros_like(point), *curves])

    width = np.diff(at)
    left, middle, right = bend(at[:-1]), bend((at[:-1] + at[1:]) / 2), bend(at[1:])
    raw_penalty = sum(
        factor * (part * (width / 6)[:, None]).T @ part
        for factor, part in ((1, left), (4, middle), (1, right))
    )
    to_basis = np.linalg.inv(upper) * scale
    return Spline(basis * scale, to_basis.T @ raw_penalty @ to_basis)


def natural_basis(values: list[int], knots: int = 10) -> np.ndarray:
    return natural_spline(values, knots).basis
