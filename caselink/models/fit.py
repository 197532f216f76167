"""Batches of additive logistic models over compressed covariate patterns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselink import config as C
from caselink.models.margins import COMPILED, Layout, dot, entry_sums, fitted_sums, level_counts, without_levels, without_smooths
from caselink.models.penalised import Fit, run_fits
from caselink.models.separation import ZERO, direction_table, off_the_plane, separating_directions
from caselink.models.splines import Spline, natural_spline
from caselink.operators.cohorts import COHORT_COLUMNS, with_age_groups
from caselink.session import bounded_tasks, savepoint, settings, shared_stage

SMOOTHS = ["date_year", "idade"]
ADJUSTMENT = ["vs_type2", "prev_infected", "sexo", "uf", "n_comorb"]
PREGNANCY = ["puerpera", "gestante"]
#: Pregnancy terms are in a model if someone in its cohort is this old or younger.
PREGNANCY_AGE = 55
REFERENCES = {
    "vs_type2": C.NEVER_VACCINATED,
    "prev_infected": "No-Prev-Infected",
    "sexo": "F",
    "uf": "35",
    "n_comorb": "0",
    "puerpera": "0",
    "gestante": "0",
    "raca": C.RACE_LABELS[3],
}
TERM_SCHEMA = "fit int, term string, estimate double, std_error double, converged boolean, reason string"


def compress(cohort: DataFrame, root: str | None = None) -> DataFrame:
    """Cases and records per covariate pattern, written once and shared by all fits.

    The binomial likelihood depends on the data only through these counts, so fits are unchanged.
    """
    keys = [*ADJUSTMENT, *PREGNANCY, "raca", *SMOOTHS, "idade_cat", "confirmado", *COHORT_COLUMNS]
    patterns = (
        cohort.transform(with_age_groups)
        .groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .withColumn("cases", F.when(F.col("confirmado") == C.CASE, F.col("n")).otherwise(F.lit(0)))
    )
    return shared_stage(patterns, "patterns", root)


@dataclass(frozen=True)
class FitSpec:
    """One model: which records, which terms. ``key`` names it in tables of several.

    Without the reference level of a ``required`` factor none of its contrasts is estimable, and the
    fit is not made. ``pregnancy`` adds those terms where the cohort is young enough for them.
    """

    key: dict[str, str] = field(default_factory=dict)
    where: Column | None = None
    factors: tuple[str, ...] = ()
    smooths: tuple[str, ...] = tuple(SMOOTHS)
    references: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ("vs_type2",)
    pregnancy: bool = False

    def reference(self, factor: str) -> str | None:
        return {**REFERENCES, **self.references}.get(factor)

    def condition(self) -> Column:
        return F.lit(True) if self.where is None else self.where


def _with_pregnancy(patterns: DataFrame, specs: Sequence[FitSpec]) -> list[FitSpec]:
    asked = [i for i, s in enumerate(specs) if s.pregnancy]
    if not asked:
        return list(specs)
    youngest = patterns.agg(*[F.min(F.when(specs[i].condition(), F.col("idade"))).alias(f"a{i}") for i in asked]).first()
    out = [replace(s, pregnancy=False) for s in specs]
    for i in asked:
        age = youngest[f"a{i}"]
        if age is not None and age <= PREGNANCY_AGE:
            out[i] = replace(out[i], factors=(*out[i].factors, *PREGNANCY))
    return out


def _layout(patterns: DataFrame, factors: Sequence[str], width: int) -> Layout:
    """All levels of all factors, from one job; bounded by the level lists."""
    text = patterns.select(*[F.col(f).cast("string").alias(f) for f in factors])
    seen = text.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("l")) for f in factors])).alias("e"))
    names: dict[str, list[str]] = {f: [] for f in factors}
    if factors:
        for row in seen.select("e.f", "e.l").where("l IS NOT NULL").distinct().collect():
            names[row.f].append(row.l)
    return Layout(tuple(factors), tuple(tuple(sorted(names[f])) for f in factors), width)


def _coded(patterns: DataFrame, specs: Sequence[FitSpec], layout: Layout, smooths: Sequence[str]) -> DataFrame:
    """``fit``, a code per factor, the smooths' values, ``n`` and ``cases`` of the complete records of each
    fit, grouped by the fit's own covariates and written."""
    member = F.array_compact(F.array(*[F.when(s.condition(), F.lit(i)) for i, s in enumerate(specs)]))
    # A pattern's levels are looked up once, not once for each of its fits.
    found = [
        F.array_position(F.lit(list(levels) or [""]), F.col(factor).cast("string")).alias(f"_f{i}")
        for i, (factor, levels) in enumerate(zip(layout.factors, layout.levels))
    ]
    found += [F.col(smooth).alias(f"_s{i}") for i, smooth in enumerate(smooths)]
    rows = patterns.select(member.alias("_fits"), *found, "n", "cases").select(F.explode("_fits").alias("fit"), "*")
    columns = {}
    for i, factor in enumerate(layout.factors):
        used = [k for k, s in enumerate(specs) if factor in s.factors]
        columns[f"f{i}"] = F.when(F.col("fit").isin(used), F.col(f"_f{i}")).otherwise(0).cast("int")
    codes = ["fit", *columns]
    for i, smooth in enumerate(smooths):
        used = [k for k, s in enumerate(specs) if smooth in s.smooths]
        columns[f"s{i}"] = F.when(F.col("fit").isin(used), F.col(f"_s{i}")).otherwise(0).cast("int")
    keys = ["fit", *columns]
    coded = rows.select("fit", *[c.alias(name) for name, c in columns.items()], "n", "cases").dropna(subset=keys)
    # A combination of levels lies in one file, so that a scan sums it in one task.
    coded = coded.repartition(*codes) if smooths else coded
    grouped = coded.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("cases").alias("cases"))
    with bounded_tasks(grouped, copies=len(specs)):
        return savepoint(grouped, "design")


def _estimable(
    rows: DataFrame, layout: Layout
) -> tuple[DataFrame, dict[tuple[int, int], tuple[int, int]], dict[tuple[int, int], str], list[dict[int, np.ndarray]]]:
    """Leave out levels seen only among cases or only among controls, until none is left.

    Their coefficient is infinite and takes up all of their records' likelihood, so the other
    coefficients are those of the fit without them. Returns the rows that are left, their level counts,
    the reasons of the levels that went, and each round's direction: up for cases, down for controls.
    """
    reasons: dict[tuple[int, int], str] = {}
    directions = []
    while True:
        seen = level_counts(rows, layout)
        one_sided = {at: "no_cases" if cases == 0 else "no_controls" for at, (cases, n) in seen.items() if cases in (0, n)}
        if not one_sided:
            return rows, seen, reasons, directions
        reasons |= one_sided
        rows = without_levels(rows, layout, list(one_sided))
        round_: dict[int, np.ndarray] = {}
        for (k, entry), reason in one_sided.items():
            round_.setdefault(k, np.zeros(layout.entries))[entry] = -1.0 if reason == "no_cases" else 1.0
        directions.append(round_)


def _with_basis(
    rows: DataFrame, specs: Sequence[FitSpec], fits: Sequence[int], smooths: Sequence[str], knots: int
) -> tuple[DataFrame, dict[tuple[int, int], Spline], tuple[np.ndarray, ...]]:
    """Attach ``b``, the columns of all smooths, and ``p0``, ``p1`` and so on, the numbers of their values, from
    tables with a row per fit and distinct value. Also returns these columns by fit and number."""
    splines: dict[tuple[int, int], Spline] = {}
    if not smooths:
        return rows, splines, ()
    width = knots - 1
    seen = rows.select("fit", F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(f"s{i}").alias("v")) for i in range(len(smooths))])).alias("e"))
    values: dict[tuple[int, int], list[int]] = {}
    for r in seen.select("fit", "e.s", "e.v").distinct().collect():
        values.setdefault((r.fit, r.s), []).append(r.v)
    curves = []
    for i, smooth in enumerate(smooths):
        table = []
        most = max((len(values.get((k, i), [])) for k in fits), default=0)
        curve = np.zeros((len(specs), max(most, 1), width))
        for k in fits:
            if smooth in specs[k].smooths:
                at = sorted(values.get((k, i), []))
                spline = splines[k, i] = natural_spline(at, knots)
                padded = np.zeros((len(at), width))
                padded[:, : spline.basis.shape[1]] = spline.basis
            else:
                at, padded = [0], np.zeros((1, width))
            curve[k, : len(at)] = padded
            table += [(k, v, number, row) for number, (v, row) in enumerate(zip(at, padded.tolist()))]
        curves.append(curve)
        # An exchange by fit and value would part the records of a combination, and gather those of a busy day.
        frame = F.broadcast(rows.sparkSession.createDataFrame(table, f"_fit int, _v int, p{i} int, b{i} array<double>"))
        rows = rows.join(frame, (F.col("fit") == F.col("_fit")) & (F.col(f"s{i}") == F.col("_v"))).drop("_fit", "_v")
    parts = [F.col(f"b{i}") for i in range(len(smooths))]
    codes = [c for c in rows.columns if c.startswith("f")]
    values_ = [f"{c}{i}" for i in range(len(smooths)) for c in "sp"]
    framed = savepoint(rows.select(*codes, *values_, F.concat(*parts).alias("b"), "n", "cases"), "framed")
    return framed, splines, tuple(curves)


class Fitted:
    """The fits of a batch, and what is needed to predict from them."""

    def __init__(self, specs: list[FitSpec], layout: Layout, bias_reduced: bool = False):
        self.specs, self.layout, self.bias_reduced = specs, layout, bias_reduced
        self.fits: dict[int, Fit] = {}
        self.frames: list[tuple[DataFrame, Layout, list[int]]] = []
        self.reasons: dict[tuple[int, int], str] = {}
        self.separated: dict[int, set[int]] = {}
        self.cut: list[tuple[DataFrame, Layout, dict[int, np.ndarray]]] = []
        self.lost: dict[int, list[int]] = {}

    def _name(self, entry: int) -> str:
        if entry == 0:
            return "(Intercept)"
        i = max(i for i, start in enumerate(self.layout.offsets) if entry >= start)
        return f"{self.layout.factors[i]}{self.layout.levels[i][entry - self.layout.offsets[i] - 1]}"

    def terms(self, spark) -> DataFrame:
        """``fit, term, estimate, std_error, converged, reason``; a null estimate has a reason."""
        rows = []
        for (k, entry), reason in self.reasons.items():
            rows.append((k, self._name(entry), None, None, True, reason))
        for k, entries in self.lost.items():
            rows += [(k, self._name(e), None, None, True, "no_reference") for e in entries]
        for k, fit in self.fits.items():
            errors = np.sqrt(np.maximum(np.diag(fit.covariance), 0))
            for entry in fit.columns:
                if not fit.converged:
                    rows.append((k, self._name(entry), None, None, False, "not_converged"))
                elif entry in self.separated.get(k, ()):
                    rows.append((k, self._name(entry), None, None, True, "separated"))
                elif entry in fit.aliased:
                    rows.append((k, self._name(entry), None, None, True, "aliased"))
                else:
                    rows.append((k, self._name(entry), float(fit.coefficients[entry]), float(errors[entry]), True, None))
        return spark.createDataFrame(rows, TERM_SCHEMA)

    def keyed(self, rows: DataFrame) -> DataFrame:
        """Rows with a ``fit`` number as rows with the keys of the fits."""
        names = list(dict.fromkeys(n for s in self.specs for n in s.key))
        if not names:
            return rows.drop("fit")
        table = [(k, *[s.key.get(n) for n in names]) for k, s in enumerate(self.specs)]
        keys = rows.sparkSession.createDataFrame(table, ", ".join(["_fit int", *[f"{n} string" for n in names]]))
        rest = [c for c in rows.columns if c != "fit"]
        return rows.join(F.broadcast(keys), F.col("fit") == F.col("_fit")).select(*names, *rest)

    def scores(self) -> DataFrame:
        """``fit, factor, level, records, observed, fitted`` of converged fits, from a prediction pass.

        A fit's maximum has as many fitted as observed cases in every level; that of a bias-reduced fit
        when the reduction's part of the score is taken off the fitted ones.
        """
        size = len(self.specs)
        out = None
        for rows, layout, members in self.frames:
            done = [k for k in members if self.fits[k].converged]
            coefficients = np.zeros((size, layout.entries))
            for k in done:
                coefficients[k] = self.fits[k].coefficients
            spreads = None
            if self.bias_reduced:
                spreads = np.zeros((size, layout.entries, layout.entries))
                for k in done:
                    spreads[k] = self.fits[k].covariance
            found = fitted_sums(rows.where(F.col("fit").isin(done or [-1])), layout, coefficients, spreads)
            out = found if out is None else out.unionByName(found)
        for rows, of, directions in self.cut:
            # Far along a separating direction a record's probability is zero or one.
            end = dot(of, direction_table(of, directions, size))
            ends = F.when(end > 0, F.col("n")).otherwise(0).cast("double")
            sums = {"records": F.col("n"), "observed": F.col("cases"), "fitted": ends}
            out = out.unionByName(entry_sums(rows, of, sums))
        if out is None:
            raise ValueError("no model could be fitted")
        out = out.groupBy("fit", "entry").agg(*[F.sum(c).alias(c) for c in ("records", "observed", "fitted")])
        with settings(out.sparkSession, COMPILED):
            out = savepoint(out, "scores")
        every = self.layout
        names = [
            (start + 1 + j, factor, level)
            for start, factor, levels in zip(every.offsets, every.factors, every.levels)
            for j, level in enumerate(levels)
        ]
        spark = out.sparkSession
        table = spark.createDataFrame(names, "_entry int, factor string, level string")
        joined = out.join(F.broadcast(table), F.col("entry") == F.col("_entry"))
        return joined.select("fit", "factor", "level", "records", "observed", "fitted")


def _columns(spec: FitSpec, k: int, layout: Layout, seen: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The intercept and every level but the reference; factors with one level drop out."""
    columns = [0]
    for start, factor, levels in zip(layout.offsets, layout.factors, layout.levels):
        if factor not in spec.factors:
            continue
        here = {level: start + 1 + j for j, level in enumerate(levels) if (k, start + 1 + j) in seen}
        if len(here) < 2:
            continue
        reference = spec.reference(factor)
        if reference not in here:
            reference = max(here, key=lambda level: (seen[k, here[level]][1], level))
        columns += [entry for level, entry in here.items() if level != reference]
    return columns


def fit_all(
    patterns: DataFrame,
    specs: Sequence[FitSpec],
    knots: int = 10,
    penalised: bool = True,
    bias_reduced: bool = False,
    max_steps: int | None = None,
) -> Fitted:
    """Fit all models in as many scans as the slowest needs.

    The smooths' roughness is chosen by restricted maximum likelihood; ``penalised=False`` fits them
    freely. Levels of one result only, and combinations of levels that separate cases from controls, have
    no finite estimate; their records leave the fit, whose other estimates are not changed by that.
    ``bias_reduced`` (Jeffreys' prior) keeps all records and has finite estimates for all levels.
    """
    specs = _with_pregnancy(patterns, specs)
    factors = list(dict.fromkeys(f for s in specs for f in s.factors))
    smooths = list(dict.fromkeys(f for s in specs for f in s.smooths))
    layout = _layout(patterns, factors, (knots - 1) * len(smooths))
    fitted = Fitted(specs, layout, bias_reduced)
    _fit(fitted, _coded(patterns, specs, layout, smooths), list(range(len(specs))), smooths, knots, penalised, bias_reduced, max_steps)
    return fitted


def _fit(
    out: Fitted,
    rows: DataFrame,
    members: list[int],
    smooths: Sequence[str],
    knots: int,
    penalised: bool,
    bias_reduced: bool,
    max_steps: int | None,
    checked: frozenset[int] = frozenset(),
    first: bool = True,
) -> None:
    """Fit the ``members``; those that turn out separated go round again without the separated records."""
    layout = out.layout
    if bias_reduced:
        seen = level_counts(rows, layout)
    else:
        whole = rows
        rows, seen, reasons, rounds = _estimable(rows, layout)
        out.reasons |= {at: reason if first else "separated" for at, reason in reasons.items()}
        # Levels that only a separation has left with one result are part of it.
        for directions in rounds if not first else []:
            narrow = {k: d[: layout.smooth_offset] for k, d in directions.items()}
            of = without_smooths(layout)
            off = off_the_plane(of, narrow, len(out.specs))
            out.cut.append((whole.where(off), of, narrow))
            whole = whole.where(~off)
    going = []
    for k in members:
        spec = out.specs[k]
        if not first:
            going.append(k)
            continue
        own = [(f, layout.offsets[i]) for i, f in enumerate(layout.factors) if f in spec.required and f in spec.factors]
        lost = [f for f, _ in own if (spec.reference(f) not in layout.levels[layout.factors.index(f)]) or (k, layout.entry(f, spec.reference(f))) not in seen]
        if lost:
            for f in lost:
                i = layout.factors.index(f)
                span = range(layout.offsets[i] + 1, layout.offsets[i] + layout.codes[i])
                out.lost[k] = out.lost.get(k, []) + [e for e in span if (k, e) in seen]
        else:
            going.append(k)
    if not going:
        return
    framed, splines, curves = _with_basis(rows.where(F.col("fit").isin(going)), out.specs, going, smooths, knots)
    layout = replace(layout, curves=curves)
    fits = {}
    for k in going:
        parts = []
        for i in range(len(smooths)):
            if (k, i) in splines:
                spline = splines[k, i]
                start = layout.smooth_offset + i * (knots - 1)
                parts.append((start, spline.penalty, spline.rank if penalised else 0))
        fits[k] = Fit(_columns(out.specs[k], k, layout, seen), parts, layout.entries)
    watched = not bias_reduced and not set(going) <= checked
    run_fits(framed, layout, fits, bias_reduced, stop_suspects=watched, max_steps=max_steps)
    odd = [k for k, f in fits.items() if f.suspect and k not in checked] if watched else []
    if odd:
        moves = {k: fits[k].move for k in odd}
        directions = separating_directions(framed, layout, {k: fits[k].free() for k in odd}, moves)
        left = rows.where(F.col("fit").isin(odd))
        if directions:
            off = off_the_plane(layout, directions, len(out.specs))
            out.cut.append((framed.where(off), layout, directions))
            # Back to the smooths' values, which the next round's splines are made of.
            left = framed.where(F.col("fit").isin(odd) & ~off).drop("b", *[f"p{i}" for i in range(len(smooths))])
            for k, direction in directions.items():
                part = np.abs(direction[: layout.smooth_offset])
                out.separated.setdefault(k, set()).update(np.flatnonzero(part > ZERO).tolist())
            gone = {at for at in seen if at[0] in directions} - set(level_counts(left, layout))
            out.reasons |= {at: "separated" for at in gone}
        for k in odd:
            del fits[k]
        again = frozenset(checked | (set(odd) - set(directions)))
        _fit(out, left, odd, smooths, knots, penalised, bias_reduced, max_steps, again, first=False)
    if watched and any(f.suspect for f in fits.values()):
        # Looked at before and found sound: large, but finite.
        run_fits(framed, layout, {k: f for k, f in fits.items() if not f.converged}, bias_reduced, max_steps=max_steps)
    out.fits |= fits
    if fits:
        out.frames.append((framed, layout, list(fits)))


def fit_logit(
    patterns: DataFrame,
    factors: Sequence[str],
    smooths: Sequence[str] = tuple(SMOOTHS),
    references: dict[str, str] | None = None,
    required: Sequence[str] = ("vs_type2",),
    knots: int = 10,
    penalised: bool = True,
    bias_reduced: bool = False,
    max_steps: int | None = None,
) -> DataFrame:
    """Terms of one model: ``term, estimate, std_error, converged, reason``."""
    spec = FitSpec(
        factors=tuple(factors), smooths=tuple(smooths), references=references or {}, required=tuple(required)
    )
    fitted = fit_all(patterns, [spec], knots, penalised, bias_reduced, max_steps)
    return fitted.terms(patterns.sparkSession).drop("fit")
