"""Cross-products of additive models from sums over margins.

A record of a model whose terms are factors and smooths has one entry per factor (its level) and one
value per smooth column; nothing else of a design matrix is ever built. The cross-products that a
fit needs are sums of weights by level, by pair of levels, and by entry times smooth column: plain
grouped sums of exploded codes, for all fits of a batch at once. What a task holds per record does
not depend on the number of levels, and what reaches the driver on the rows not at all.

Where the values of the smooths are numbered (``Layout.curves``), a record counts once in its combination
of levels and once in the value of each smooth; levels and pairs of levels are summed from the
combinations, of which there are no more for more records.

Coefficients travel as constant arrays indexed by fit and code.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselink.session import settings

#: Linear predictors are kept in the range where probabilities stay off 0 and 1.
MAX_ETA = 30.0
#: The JVM does not compile methods beyond 8,000 bytes, which a predictor of many terms reaches. Spark then
#: makes its steps one by one, in smaller methods.
COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}


@dataclass(frozen=True)
class Layout:
    """Numbers of the entries of all fits: intercept, then factor levels by code, then smooth columns.

    Code 0 of a factor stands for a fit without it. ``curves`` has, for each smooth, its columns by fit
    and number of the value, which a record has in ``p0``, ``p1`` and so on.
    """

    factors: tuple[str, ...]
    levels: tuple[tuple[str, ...], ...]
    width: int
    curves: tuple[np.ndarray, ...] = field(default=(), compare=False, repr=False)

    @property
    def codes(self) -> list[int]:
        return [len(names) + 1 for names in self.levels]

    @property
    def offsets(self) -> list[int]:
        return [1 + sum(self.codes[:i]) for i in range(len(self.factors))]

    @property
    def smooth_offset(self) -> int:
        return 1 + sum(self.codes)

    @property
    def entries(self) -> int:
        return self.smooth_offset + self.width

    @property
    def pairs(self) -> list[tuple[int, int, int]]:
        """Factors of a pair and the number of its first cell."""
        out, at = [], self.entries
        for i in range(len(self.factors)):
            for j in range(i):
                out.append((i, j, at))
                at += self.codes[i] * self.codes[j]
        return out

    @property
    def cells(self) -> int:
        return self.entries + sum(self.codes[i] * self.codes[j] for i in range(len(self.factors)) for j in range(i))

    @property
    def smooths(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Number, first smooth column and curves of each smooth."""
        start = 0
        for i, curve in enumerate(self.curves):
            yield i, start, curve
            start += curve.shape[2]

    @property
    def combinations(self) -> int:
        return math.prod(self.codes)

    def entry(self, factor: str, level: str) -> int:
        i = self.factors.index(factor)
        return self.offsets[i] + 1 + self.levels[i].index(level)


def without_smooths(layout: Layout) -> Layout:
    return Layout(layout.factors, layout.levels, 0)


def constant(values: np.ndarray) -> Column:
    """An array of doubles, or of rows of doubles, as one constant of the plan."""
    values = np.asarray(values, float)
    kind = "array<double>" if values.ndim == 1 else "array<array<double>>"
    return F.from_json(F.lit(json.dumps(values.tolist())), kind)


def _at(values: np.ndarray, index: Column) -> Column:
    return F.get(constant(values), index)


def code(i: int) -> Column:
    return F.col(f"f{i}")


def position(i: int) -> Column:
    return F.col(f"p{i}")


def dot(layout: Layout, coefficients: np.ndarray) -> Column:
    """The linear predictor: ``coefficients`` has a row of all entries per fit."""
    fit = F.col("fit")
    total = _at(coefficients[:, 0], fit)
    for i, (start, size) in enumerate(zip(layout.offsets, layout.codes)):
        flat = coefficients[:, start : start + size].ravel()
        total = total + _at(flat, fit * size + code(i))
    if layout.curves:
        for i, start, curve in layout.smooths:
            part = coefficients[:, layout.smooth_offset + start :][:, : curve.shape[2]]
            heights = np.einsum("kvw,kw->kv", curve[: len(part)], part)
            total = total + _at(heights.ravel(), fit * heights.shape[1] + position(i))
    elif layout.width:
        smooth = _at(coefficients[:, layout.smooth_offset :], fit)
        total = total + F.aggregate(F.zip_with(smooth, F.col("b"), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return total


def quadratic(layout: Layout, matrices: np.ndarray) -> Column:
    """``x' C x`` of each record, for a symmetric matrix over all entries per fit.

    With curves, the rows are those of :func:`with_curve_products`.
    """
    fit = F.col("fit")
    starts, sizes = layout.offsets, layout.codes
    total = _at(matrices[:, 0, 0], fit)
    for i, (start, size) in enumerate(zip(starts, sizes)):
        own = np.arange(start, start + size)
        line = matrices[:, own, own] + 2 * matrices[:, 0, own]
        total = total + _at(line.ravel(), fit * size + code(i))
    for i, j, _ in layout.pairs:
        block = 2 * matrices[:, starts[i] : starts[i] + sizes[i], starts[j] : starts[j] + sizes[j]]
        cell = (fit * sizes[i] + code(i)) * sizes[j] + code(j)
        total = total + _at(block.ravel(), cell)
    smooth = layout.smooth_offset
    if layout.curves:
        columns = list(layout.smooths)
        for i, _, _ in columns:
            made = F.col(f"t{i}")
            total = total + F.get(made, F.lit(0))
            for j, start in enumerate(starts):
                total = total + F.get(made, F.lit(start) + code(j))
            at = smooth
            for _, start, curve in columns[i + 1 :]:
                for k in range(curve.shape[2]):
                    total = total + F.get(made, F.lit(at + k)) * F.get(F.col("b"), F.lit(start + k))
                at += curve.shape[2]
        return total
    if not layout.width:
        return total

    def along(rows: np.ndarray, index: Column) -> Column:
        product = F.zip_with(_at(rows, index), F.col("b"), lambda x, y: x * y)
        return F.aggregate(product, F.lit(0.0), lambda a, x: a + x)

    total = total + along(2 * matrices[:, 0, smooth:], fit)
    for i, (start, size) in enumerate(zip(starts, sizes)):
        rows = 2 * matrices[:, start : start + size, smooth:]
        total = total + along(rows.reshape(-1, layout.width), fit * size + code(i))
    for k in range(layout.width):
        total = total + F.get(F.col("b"), F.lit(k)) * along(matrices[:, smooth + k, smooth:], fit)
    return total


def with_curve_products(rows: DataFrame, layout: Layout, matrices: np.ndarray) -> DataFrame:
    """Attach ``t0``, ``t1`` and so on: what the value of a smooth adds to :func:`quadratic` by itself, with
    each level, and with each column of later smooths. They come from tables with a row per fit and value."""
    smooth = layout.smooth_offset
    for i, start, curve in layout.smooths:
        curve = curve[: len(matrices)]
        count, values, width = curve.shape
        lines = 2 * matrices[:, smooth + start : smooth + start + width, :]
        made = np.einsum("kvw,kwe->kve", curve, lines[:, :, :smooth])
        own = np.einsum("kvw,kwu,kvu->kv", curve, lines[:, :, smooth + start : smooth + start + width] / 2, curve)
        made[:, :, 0] += own
        later = np.einsum("kvw,kwe->kve", curve, lines[:, :, smooth + start + width :])
        made = np.concatenate([made, later], axis=2)
        ends = np.arange(count * values + 1, dtype=np.int32) * made.shape[2]
        table = pa.table(
            {
                "_fit": pa.array(np.repeat(np.arange(count, dtype=np.int32), values)),
                "_p": pa.array(np.tile(np.arange(values, dtype=np.int32), count)),
                f"t{i}": pa.ListArray.from_arrays(pa.array(ends), pa.array(made.ravel())),
            }
        )
        frame = rows.sparkSession.createDataFrame(table)
        rows = rows.join(F.broadcast(frame), (F.col("fit") == F.col("_fit")) & (position(i) == F.col("_p"))).drop("_fit", "_p")
    return rows


def entry_sums(rows: DataFrame, layout: Layout, sums: dict[str, Column]) -> DataFrame:
    """``fit, entry`` and sums of the given columns over the records with each level (and over all)."""
    codes = [code(i) for i in range(len(layout.factors))]
    keys = [F.lit(0), *[F.lit(start) + codes[i] for i, start in enumerate(layout.offsets)]]
    # Made before the records are multiplied, not once for each entry.
    made = rows.select("fit", *codes, *[c.alias(name) for name, c in sums.items()])
    taken = made.select("fit", F.explode(F.array(*keys)).alias("entry"), *sums)
    return taken.groupBy("fit", "entry").agg(*[F.sum(name).alias(name) for name in sums])


class Products:
    """Weighted cross-products of one fit over all entries: matrix, response and deviance."""

    def __init__(self, layout: Layout):
        self.matrix = np.zeros((layout.entries, layout.entries))
        self.response = np.zeros(layout.entries)
        self.deviance = 0.0


def _by_entry(weighted: DataFrame, layout: Layout, basis: Sequence[Column]) -> DataFrame:
    """``fit, key`` and sums of the records: by entry with the smooth columns, by pair of levels alone."""
    codes = [code(i) for i in range(len(layout.factors))]

    def entry(key: Column, times: Column) -> Column:
        return F.struct(key.cast("int").alias("key"), times.cast("double").alias("x"))

    entries = [entry(F.lit(0), F.lit(1.0))]
    entries += [entry(F.lit(start) + codes[i], F.lit(1.0)) for i, start in enumerate(layout.offsets)]
    entries += [entry(F.lit(layout.smooth_offset + k), b) for k, b in enumerate(basis)]
    with_smooth = weighted.select(F.explode(F.array(*entries)).alias("e"), "*")
    first = with_smooth.groupBy("fit", F.col("e.key").alias("key")).agg(
        F.sum(F.col("e.x") * F.col("w")).alias("w"),
        F.sum(F.col("e.x") * F.col("r")).alias("r"),
        F.sum("d").alias("d"),
        *[F.sum(F.col("e.x") * F.col("w") * b).alias(f"b{k}") for k, b in enumerate(basis)],
    )
    if not layout.pairs:
        return first
    return first.unionByName(_by_pair(weighted, layout), allowMissingColumns=True)


def _by_pair(weighted: DataFrame, layout: Layout) -> DataFrame:
    codes = [code(i) for i in range(len(layout.factors))]
    cells = [(F.lit(at) + codes[i] * layout.codes[j] + codes[j]).cast("int") for i, j, at in layout.pairs]
    return weighted.select("fit", "w", F.explode(F.array(*cells)).alias("key")).groupBy("fit", "key").agg(F.sum("w").alias("w"))


def _by_combination(weighted: DataFrame, layout: Layout) -> DataFrame:
    """``fit, key`` and sums of the records by combination of levels, and by value of a smooth below zero."""
    combination = F.lit(0).cast("bigint")
    for i, size in enumerate(layout.codes):
        combination = combination * size + code(i)
    keys, first = [combination], 1
    for i, _, curve in layout.smooths:
        keys.append(F.lit(-first).cast("bigint") - position(i))
        first += curve.shape[1]
    b = F.col("b")
    return (
        weighted.select("fit", F.explode(F.array(*keys)).alias("key"), "b", "w", "r", "d")
        .groupBy("fit", "key")
        .agg(*[F.sum(c).alias(c) for c in "wrd"], *[F.sum(F.col("w") * F.get(b, F.lit(k))).alias(f"b{k}") for k in range(layout.width)])
    )


def _from_combinations(summed: DataFrame, layout: Layout) -> DataFrame:
    """``fit, key`` and sums by entry of a level, by pair of levels, and after these by value of a smooth."""
    sums = ["w", "r", "d", *[f"b{k}" for k in range(layout.width)]]
    of = summed.where(F.col("key") >= 0)
    rest, codes = F.col("key"), []
    for i, size in reversed(list(enumerate(layout.codes))):
        codes.append(F.pmod(rest, F.lit(size)).cast("int").alias(f"f{i}"))
        rest = F.call_function("div", rest, F.lit(size))
    levels = of.select("fit", *codes, *sums)
    out = entry_sums(levels, layout, {c: F.col(c) for c in sums}).withColumnRenamed("entry", "key")
    if layout.pairs:
        out = out.unionByName(_by_pair(levels, layout), allowMissingColumns=True)
    values = summed.where(F.col("key") < 0).withColumn("key", (F.lit(layout.cells - 1) - F.col("key")).cast("int"))
    return out.unionByName(values)


def products(rows: DataFrame, layout: Layout, weight: Column, response: Column, deviance: Column) -> dict[int, Products]:
    """Cross-products of each fit in ``rows``, by one grouped sum.

    ``weight`` and ``response`` are the sums that one record adds: its weight, and weight times
    working response.
    """
    width, smooth = layout.width, layout.smooth_offset
    basis = [F.get(F.col("b"), F.lit(k)) for k in range(width)]
    codes = [code(i) for i in range(len(layout.factors))]
    places = [position(i) for i in range(len(layout.curves))]
    weighted = rows.select(
        "fit", *codes, *places, *(["b"] if width else []), weight.alias("w"), response.alias("r"), deviance.alias("d")
    )
    packed = bool(places) and layout.combinations < 2**62
    # As many rows as there are pairs of levels and values of smooths. A kept frame takes over the settings
    # under which it is named.
    with settings(rows.sparkSession, COMPILED):
        if packed:
            summed = _by_combination(weighted, layout).persist()
            try:
                table = _from_combinations(summed, layout).toArrow()
            finally:
                summed.unpersist()
        else:
            table = _by_entry(weighted, layout, basis).toArrow()
    column = {name: table.column(name).to_numpy() for name in table.column_names}
    out: dict[int, Products] = {}
    for fit in np.unique(column["fit"]).tolist():
        here = column["fit"] == fit
        key = column["key"][here]
        single, made = key < layout.entries, Products(layout)
        at, w = key[single], column["w"][here][single]
        made.response[at] = column["r"][here][single]
        made.deviance = float(column["d"][here][single][at == 0].sum())
        level = at < smooth
        made.matrix[at[level], at[level]] = w[level]
        made.matrix[0, at], made.matrix[at, 0] = w, w
        for k in range(width):
            value = column[f"b{k}"][here][single]
            made.matrix[at, smooth + k], made.matrix[smooth + k, at] = value, value
        first = layout.cells
        for _, start, curve in layout.smooths if packed else ():
            mine = (key >= first) & (key < first + curve.shape[1])
            columns = curve[fit][key[mine] - first]
            inside = smooth + start + np.arange(curve.shape[2])
            made.response[inside] = columns.T @ column["r"][here][mine]
            made.matrix[0, inside] = made.matrix[inside, 0] = columns.T @ column["w"][here][mine]
            for k in range(width):
                made.matrix[inside, smooth + k] = columns.T @ column[f"b{k}"][here][mine]
            first += curve.shape[1]
        pair = ~single & (key < layout.cells)
        cell, cell_w = key[pair], column["w"][here][pair]
        for i, j, start in layout.pairs:
            size = layout.codes[j]
            mine = (cell >= start) & (cell < start + layout.codes[i] * size)
            a, b = np.divmod(cell[mine] - start, size)
            a, b = a + layout.offsets[i], b + layout.offsets[j]
            made.matrix[a, b], made.matrix[b, a] = cell_w[mine], cell_w[mine]
        out[fit] = made
    return out


def logit_products(rows: DataFrame, layout: Layout, coefficients: np.ndarray, spreads: np.ndarray | None = None) -> dict[int, Products]:
    """Cross-products of a logistic fit's working model under the given coefficients.

    ``spreads``, a covariance over all entries per fit, adds the bias reduction: a record counts as if
    its leverage were so many further trials, half of them cases.
    """
    columns = ["fit", *[f"f{i}" for i in range(len(layout.factors))], *(["b"] if layout.width else [])]
    columns += [f"p{i}" for i in range(len(layout.curves))]
    made = [] if spreads is None else [f"t{i}" for i in range(len(layout.curves))]
    if made:
        rows = with_curve_products(rows, layout, spreads)
    eta = F.greatest(F.lit(-MAX_ETA), F.least(F.lit(MAX_ETA), dot(layout, coefficients)))
    scored = rows.select(*columns, *made, "n", "cases", eta.alias("eta"))
    n, cases, p = F.col("n"), F.col("cases"), 1 / (1 + F.exp(-F.col("eta")))
    scored = scored.select(*columns, *made, "n", "cases", "eta", p.alias("p"))
    if spreads is not None:
        leverage = n * F.col("p") * (1 - F.col("p")) * quadratic(layout, spreads)
        scored = scored.withColumn("h", leverage)
        scored = scored.withColumns({"n": n + F.col("h"), "cases": cases + F.col("h") / 2})
    weight = n * F.col("p") * (1 - F.col("p"))
    deviance = -2 * (cases * F.ln("p") + (n - cases) * F.log1p(-F.col("p")))
    return products(scored, layout, weight, weight * F.col("eta") + cases - n * F.col("p"), deviance)


def fitted_sums(rows: DataFrame, layout: Layout, coefficients: np.ndarray, spreads: np.ndarray | None = None) -> DataFrame:
    """``fit, entry, records, observed, fitted``: a prediction pass, summed by level.

    With ``spreads``, fitted cases are less what the bias reduction adds to the score.
    """
    eta = F.greatest(F.lit(-MAX_ETA), F.least(F.lit(MAX_ETA), dot(layout, coefficients)))
    if spreads is not None:
        rows = with_curve_products(rows, layout, spreads)
    scored = rows.withColumn("p", 1 / (1 + F.exp(-eta)))
    n, p = F.col("n"), F.col("p")
    fitted = n * p
    if spreads is not None:
        fitted = fitted - n * p * (1 - p) * quadratic(layout, spreads) * (0.5 - p)
    return entry_sums(scored, layout, {"records": n, "observed": F.col("cases"), "fitted": fitted})


def level_counts(rows: DataFrame, layout: Layout) -> dict[tuple[int, int], tuple[int, int]]:
    """(cases, records) by fit and entry of a factor level."""
    counted = entry_sums(rows, layout, {"cases": F.col("cases"), "n": F.col("n")}).collect()
    absent = set(layout.offsets)
    return {(r.fit, r.entry): (r.cases, r.n) for r in counted if r.entry and r.entry not in absent}


def without_levels(rows: DataFrame, layout: Layout, gone: Sequence[tuple[int, int]]) -> DataFrame:
    """Rows but those with one of the given (fit, entry) levels."""
    for i, (start, size) in enumerate(zip(layout.offsets, layout.codes)):
        cells = [fit * size + entry - start for fit, entry in gone if start <= entry < start + size]
        if cells:
            rows = rows.where(~(F.col("fit") * size + code(i)).isin(cells))
    return rows
