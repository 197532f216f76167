"""Levels and combinations of levels that tell cases from controls without error.

A direction separates if no record is on its wrong side: its linear predictor is zero or more for
every case, zero or less for every control, and not zero for all. Along it the likelihood rises
without end. Such a direction is found by least squares: records of one result are asked for a
predictor of one on their side, patterns that hold both results are held at zero by a large weight,
and predictors that come out on the wrong side are next asked for zero, until none does. Each round is
one sum over margins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselink.models.margins import Layout, dot, products

HELD = 1e6
WRONG, ZERO = 1e-5, 1e-3
ROUNDS = 40


def _clear(direction: np.ndarray, layout: Layout) -> np.ndarray:
    """The factors' part of the direction, its largest entry one and all rounded to quarters.

    Directions that separate by combinations of levels have small whole entries; what an unfinished
    search adds to them is rounded away. Only directions that pass the check are ever used.
    """
    out = np.zeros(layout.entries)
    part = direction[: layout.smooth_offset]
    most = np.max(np.abs(part), initial=0.0)
    if most > 0:
        out[: layout.smooth_offset] = np.round(part / most * 4) / 4
    return out


def separating_directions(
    rows: DataFrame, layout: Layout, spans: dict[int, np.ndarray], hints: dict[int, np.ndarray] | None = None
) -> dict[int, np.ndarray]:
    """By fit, a direction over all entries that separates; fits without one are left out.

    ``rows`` has ``fit``, the codes, ``b`` if there are smooths, ``n`` and ``cases``. A column of a fit's
    ``spans`` is a direction that nothing but the likelihood holds: an entry of a factor, or the straight
    line of a smooth. ``hints`` are tried first: along which way the coefficients of an unfinished fit
    were moving.
    """
    size = max(spans, default=-1) + 1
    side = F.when(F.col("cases") == F.col("n"), 1.0).when(F.col("cases") == 0, -1.0).otherwise(0.0)
    going, found = set(spans), {}
    direction = {k: np.zeros(layout.entries) for k in spans}

    def settle(sided: DataFrame, tries: list[dict[int, np.ndarray]], last: bool) -> None:
        """Keep the first of each fit's tries that has no record on its wrong side."""
        sums = []
        for i, directions in enumerate(tries):
            reach = dot(layout, direction_table(layout, directions, size))
            # Patterns of both results must lie on the plane.
            wrong = F.when(F.col("side") == 0, -F.abs(reach)).otherwise(F.col("side") * reach)
            sums += [F.min(wrong).alias(f"least{i}"), F.max(F.col("side") * reach).alias(f"most{i}")]
        for r in sided.groupBy("fit").agg(*sums).collect():
            for i, directions in enumerate(tries):
                if r.fit in going and r[f"most{i}"] > ZERO and r[f"least{i}"] > -WRONG * max(r[f"most{i}"], 1.0):
                    found[r.fit] = directions[r.fit]
                    going.discard(r.fit)
            if last and r.fit in going and r["most0"] < ZERO:
                going.discard(r.fit)

    def sided() -> DataFrame:
        return rows.where(F.col("fit").isin(sorted(going))).withColumn("side", side)

    if hints:
        settle(sided(), [{k: _clear(hints[k], layout) for k in going}], False)
    for round_ in range(ROUNDS):
        if not going:
            break
        here = sided()
        asked = dot(layout, direction_table(layout, {k: direction[k] for k in going}, size))
        wanted = F.lit(1.0) if round_ == 0 else F.greatest(F.lit(0.0), F.col("side") * asked)
        weight = F.when(F.col("side") == 0, HELD).otherwise(1.0)
        sums = products(here, layout, weight, F.col("side") * wanted, F.lit(0.0))
        for k in going:
            span = spans[k]
            solved = np.linalg.lstsq(span.T @ sums[k].matrix @ span, span.T @ sums[k].response, rcond=1e-12)[0]
            direction[k] = span @ solved
        settle(here, [{k: direction[k] for k in going}, {k: _clear(direction[k], layout) for k in going}], True)
    return found


def direction_table(layout: Layout, directions: dict[int, np.ndarray], size: int) -> np.ndarray:
    """A row of entries per fit; zero for fits without a direction."""
    table = np.zeros((size, layout.entries))
    for k, d in directions.items():
        table[k] = d
    return table


def off_the_plane(layout: Layout, directions: dict[int, np.ndarray], size: int) -> Column:
    """Condition: the record's predictor along its fit's direction is not zero."""
    return F.abs(dot(layout, direction_table(layout, directions, size))) > ZERO
