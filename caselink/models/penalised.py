"""Penalised logistic fits, many at a time, from distributed cross-products.

Each iteration is one Spark job for all fits that have not ended (``margins``). The driver only ever
holds matrices whose size is the number of model terms.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.models.margins import Layout, Products, logit_products

#: Iterations allowed for a fit, and for the penalty strengths inside each of them.
MAX_STEPS, MAX_STRENGTH_STEPS = 40, 500
TOLERANCE = 1e-9  # relative change of the penalised deviance
ALIASED = 1e-9
#: Log odds ratios beyond this are looked at for separation before the fit goes on.
SUSPECT = 12.0


def independent_columns(product: np.ndarray) -> np.ndarray:
    """Columns not a combination of earlier ones, by a Cholesky sweep over the scaled matrix."""
    size = len(product)
    scale = np.sqrt(np.maximum(np.diag(product), 0))
    kept: list[int] = []
    factor = np.zeros((size, size))
    for j in range(size):
        if scale[j] == 0:
            continue
        scaled = product[j, kept] / (scale[j] * scale[kept])
        row = np.zeros(len(kept))
        for i in range(len(kept)):
            row[i] = (scaled[i] - factor[i, :i] @ row[:i]) / factor[i, i]
        left = 1 - row @ row
        if left > ALIASED:
            factor[len(kept), : len(kept)] = row
            factor[len(kept), len(kept)] = np.sqrt(left)
            kept.append(j)
    return np.array(kept, dtype=int)


def _strengths(
    product: np.ndarray, response: np.ndarray, penalties: list[np.ndarray], ranks: list[int], strength: np.ndarray
) -> np.ndarray:
    """Penalty strengths towards the REML optimum of the working model, all of whose columns are smooth.

    Fellner-Schall updates: each raises the restricted likelihood and keeps strengths positive. A
    smooth that is a straight line has no finite optimum and its strength drifts on without an
    effect, so whether a fit has ended is told from its coefficients.
    """
    for _ in range(MAX_STRENGTH_STEPS):
        covariance = np.linalg.inv(product + sum(s * p for s, p in zip(strength, penalties)))
        coefficients = covariance @ response
        taken = np.array([s * np.sum(covariance * p) for s, p in zip(strength, penalties)])
        updated = np.array(
            [
                np.clip((rank - t) / max(coefficients @ p @ coefficients, 1e-12), 1e-8, 1e10)
                for t, p, rank in zip(taken, penalties, ranks)
            ]
        )
        if np.max(np.abs(np.log(updated / strength))) < 1e-6:
            break
        strength = updated
    return strength


def _solve(
    product: np.ndarray, response: np.ndarray, penalties: list[np.ndarray], ranks: list[int], strength: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, covariance and penalty strengths of the working model.

    The strengths depend on the other columns only through what these leave of the smooth ones.
    """
    if len(strength):
        smooth = np.flatnonzero(sum(np.abs(p).sum(axis=0) for p in penalties) > 0)
        other = np.setdiff1d(np.arange(len(product)), smooth)
        across = np.linalg.solve(product[np.ix_(other, other)], product[np.ix_(other, smooth)])
        left = product[np.ix_(smooth, smooth)] - product[np.ix_(smooth, other)] @ across
        blocks = [p[np.ix_(smooth, smooth)] for p in penalties]
        strength = _strengths(left, response[smooth] - across.T @ response[other], blocks, ranks, strength)
    covariance = np.linalg.inv(product + sum(s * p for s, p in zip(strength, penalties)))
    return covariance @ response, covariance, strength


@dataclass
class Fit:
    """One fit of a batch: its columns among all entries, its penalties, and where it has come to."""

    columns: list[int]  # entries of the parametric columns, the intercept first
    smooths: list[tuple[int, np.ndarray, int]]  # first entry, penalty and rank of each smooth
    entries: int
    coefficients: np.ndarray = field(init=False)  # over all entries
    covariance: np.ndarray = field(init=False)  # the same, zero where there is no estimate
    move: np.ndarray = field(init=False)  # of the coefficients in the last step
    converged: bool = False
    suspect: bool = False
    aliased: set[int] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.coefficients = np.zeros(self.entries)
        self.covariance = np.zeros((self.entries, self.entries))
        self.move = np.zeros(self.entries)
        self._used = [s for s in self.smooths if s[2] > 0]
        self._strength = np.ones(len(self._used))
        self._kept: np.ndarray | None = None
        self._previous = np.inf
        smooth = [c for start, penalty, _ in self.smooths for c in range(start, start + len(penalty))]
        self._all = np.array([*self.columns, *smooth], dtype=int)

    def _penalty(self, start: int, penalty: np.ndarray) -> np.ndarray:
        full = np.zeros((self.entries, self.entries))
        full[start : start + len(penalty), start : start + len(penalty)] = penalty
        return full

    def free(self) -> np.ndarray:
        """Directions, one a column, that no penalty holds: parametric entries and straight lines."""
        parts = [np.eye(self.entries)[:, self.columns]]
        for start, penalty, rank in self.smooths:
            if len(penalty):
                _, vectors = np.linalg.eigh(penalty)
                line = np.zeros((self.entries, len(penalty) - rank))
                line[start : start + len(penalty)] = vectors[:, : len(penalty) - rank]
                parts.append(line)
        return np.column_stack(parts)

    def _find_independent(self, made: Products) -> None:
        if self._kept is None:
            independent = independent_columns(made.matrix[np.ix_(self._all, self._all)])
            self._kept = self._all[independent]
            self.aliased = set(self._all.tolist()) - set(self._kept.tolist())

    def spread(self, made: Products) -> None:
        """The covariance under the present coefficients and strengths."""
        self._find_independent(made)
        block = np.ix_(self._kept, self._kept)
        total = made.matrix[block] + sum(
            s * self._penalty(start, penalty)[block] for s, (start, penalty, _) in zip(self._strength, self._used)
        )
        self.covariance = np.zeros((self.entries, self.entries))
        self.covariance[block] = np.linalg.inv(total)

    def step(self, made: Products) -> None:
        """Take in the cross-products under the present coefficients."""
        self._find_independent(made)
        penalties = [self._penalty(start, penalty) for start, penalty, _ in self._used]
        objective = made.deviance + sum(
            s * self.coefficients @ p @ self.coefficients for s, p in zip(self._strength, penalties)
        )
        kept, block = self._kept, np.ix_(self._kept, self._kept)
        last, self.coefficients = self.coefficients, np.zeros(self.entries)
        self.coefficients[kept], covariance, self._strength = _solve(
            made.matrix[block], made.response[kept], [p[block] for p in penalties], [r for _, _, r in self._used], self._strength
        )
        self.covariance = np.zeros((self.entries, self.entries))
        self.covariance[block] = covariance
        self.move = self.coefficients - last
        moved = np.max(np.abs(self.coefficients - last) / (1 + np.abs(last)), initial=0.0)
        settled = abs(self._previous - objective) < TOLERANCE * (abs(objective) + 0.1)
        self.converged = bool(settled and moved < 1e-6)
        self._previous = objective
        # Without the intercept, which takes up what the reference levels have in common.
        self.suspect = bool(np.max(np.abs(self.coefficients[self.columns[1:]]), initial=0.0) > SUSPECT)


def run_fits(
    rows: DataFrame,
    layout: Layout,
    fits: dict[int, Fit],
    bias_reduced: bool = False,
    stop_suspects: bool = False,
    max_steps: int | None = None,
) -> None:
    """Iterate all fits over ``rows`` (``fit``, codes, ``b``, ``n``, ``cases``) until each has ended.

    As many scans as the slowest fit needs steps; twice as many where bias is reduced, since leverages
    take a covariance that is summed first. With ``stop_suspects`` a fit ends, unconverged, where a
    coefficient becomes implausible.
    """
    size = max(fits, default=-1) + 1

    def under_present(going: list[int], spreads: np.ndarray | None = None) -> dict[int, Products]:
        coefficients = np.zeros((size, layout.entries))
        for k in going:
            coefficients[k] = fits[k].coefficients
        made = logit_products(rows.where(F.col("fit").isin(going)), layout, coefficients, spreads)
        return {k: made.get(k) or Products(layout) for k in going}

    def covariances(going: list[int]) -> np.ndarray:
        spreads = np.zeros((size, layout.entries, layout.entries))
        for k, made in under_present(going).items():
            fits[k].spread(made)
            spreads[k] = fits[k].covariance
        return spreads

    for _ in range(MAX_STEPS if max_steps is None else max_steps):
        going = [k for k, f in fits.items() if not f.converged and not (stop_suspects and f.suspect)]
        if not going:
            break
        for k, made in under_present(going, covariances(going) if bias_reduced else None).items():
            fits[k].step(made)
    if bias_reduced and fits:
        covariances(list(fits))
