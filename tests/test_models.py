"""Fits against closed forms and a plain Newton solve."""

from __future__ import annotations

import math

import numpy as np
import pytest
from caselink import config as C
from caselink.models import extract_ve, fit_logit, ve_figure_frame
from caselink.models.effectiveness import ve_model
from caselink.models.splines import natural_basis, natural_spline

FRAME = (
    "vs_type2 string, prev_infected string, sexo string, uf string, n_comorb string, puerpera int, "
    "gestante int, date_year int, idade int, n bigint, cases bigint"
)


def records(count=4000, seed=3):
    rng = np.random.default_rng(seed)
    labels = ["uv", "CV_v2_0:13", "CV_v2_181+", "AZ_v1_14+"]
    rows = []
    for _ in range(count):
        label, sex, age, when = rng.integers(4), rng.integers(2), int(rng.integers(18, 60)), int(rng.integers(0, 90))
        risk = -0.5 - 0.4 * label + 0.3 * sex + 0.01 * (age - 40) + 0.5 * math.sin(when / 15)
        case = int(rng.random() < 1 / (1 + math.exp(-risk)))
        rows.append((labels[label], "Prev-Infected" if rng.random() < 0.3 else "No-Prev-Infected", "FM"[sex], "35", "0", 0, 0, when, age, 1, case))
    return rows


def newton(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        mu = 1 / (1 + np.exp(-x @ beta))
        information = x.T @ (x * (mu * (1 - mu))[:, None])
        beta = beta + np.linalg.solve(information, x.T @ (y - mu))
    return beta, np.sqrt(np.diag(np.linalg.inv(information)))


def terms(df) -> dict:
    return {r["term"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    return records()


def test_single_factor_fit_is_the_crude_odds_ratio(spark, rows):
    got = terms(fit_logit(spark.createDataFrame(rows, FRAME), ["vs_type2"], smooths=[]))
    count = {}
    for r in rows:
        count[r[0], r[-1]] = count.get((r[0], r[-1]), 0) + 1
    for label in ("CV_v2_0:13", "CV_v2_181+", "AZ_v1_14+"):
        a, b, c, d = count[label, 1], count[label, 0], count["uv", 1], count["uv", 0]
        assert got[f"vs_type2{label}"]["estimate"] == pytest.approx(math.log(a * d / (b * c)), abs=1e-6)
        assert got[f"vs_type2{label}"]["std_error"] == pytest.approx(
            math.sqrt(1 / a + 1 / b + 1 / c + 1 / d), abs=1e-6
        )


def test_full_fit_matches_newton_and_does_not_depend_on_compression(spark, rows):
    df = spark.createDataFrame(rows, FRAME)
    factors = ["vs_type2", "prev_infected", "sexo", "uf"]
    got = terms(fit_logit(df, factors, penalised=False))
    keys = [c for c in df.columns if c not in ("n", "cases")]
    packed = df.groupBy(*keys).agg({"n": "sum", "cases": "sum"}).withColumnsRenamed(
        {"sum(n)": "n", "sum(cases)": "cases"}
    )
    again = terms(fit_logit(packed.repartition(3), factors, penalised=False))

    days, ages = sorted({r[7] for r in rows}), sorted({r[8] for r in rows})
    spline_day = dict(zip(days, natural_basis(days)))
    spline_age = dict(zip(ages, natural_basis(ages)))
    names = ["CV_v2_0:13", "CV_v2_181+", "AZ_v1_14+"]
    x = np.array(
        [
            [1.0, *[float(r[0] == n) for n in names], float(r[1] == "Prev-Infected"), float(r[2] == "M"), *spline_day[r[7]], *spline_age[r[8]]]
            for r in rows
        ]
    )
    beta, error = newton(x, np.array([r[-1] for r in rows], dtype=float))
    expected = dict(zip(["(Intercept)", *[f"vs_type2{n}" for n in names], "prev_infectedPrev-Infected", "sexoM"], zip(beta, error)))
    assert set(got) == set(expected)  # constant factors dropped out
    for name, (estimate, se) in expected.items():
        assert got[name]["converged"]
        for fit in (got, again):
            assert fit[name]["estimate"] == pytest.approx(estimate, abs=1e-5)
            assert fit[name]["std_error"] == pytest.approx(se, abs=1e-5)


def test_one_sided_levels_leave_the_rest_unchanged(spark, rows):
    lonely = ("CV_v1_0:6", "No-Prev-Infected", "F", "35", "0", 0, 0, 10, 30, 5, 0)
    without = terms(fit_logit(spark.createDataFrame(rows, FRAME), ["vs_type2", "sexo"], smooths=[]))
    having = terms(fit_logit(spark.createDataFrame([*rows, lonely], FRAME), ["vs_type2", "sexo"], smooths=[]))
    assert having["vs_type2CV_v1_0:6"]["estimate"] is None
    for name, row in without.items():
        assert having[name]["estimate"] == pytest.approx(row["estimate"], abs=1e-8)


def test_change_of_reference_is_a_difference(spark, rows):
    df = spark.createDataFrame(rows, FRAME)
    base = terms(ve_model(df))
    moved = terms(ve_model(df, references={"vs_type2": "CV_v2_181+"}))
    assert moved["vs_type2CV_v2_0:13"]["estimate"] == pytest.approx(
        base["vs_type2CV_v2_0:13"]["estimate"] - base["vs_type2CV_v2_181+"]["estimate"], abs=1e-6
    )


def test_lost_reference_gives_nulls(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[0] != "uv"], FRAME)
    got = terms(fit_logit(df, ["vs_type2", "sexo"], smooths=[]))
    assert got["vs_type2CV_v2_0:13"]["estimate"] is None


def test_basis_is_orthonormal_and_natural():
    values = list(range(0, 200, 3))
    basis = natural_basis(values, 10)
    assert basis.shape == (len(values), 9)
    assert np.allclose(basis.T @ basis, len(values) * np.eye(9))
    assert np.allclose(basis.sum(axis=0), 0)
    # A straight line lies in the span.
    line = np.array(values, dtype=float)
    line -= line.mean()
    assert np.allclose(basis @ np.linalg.lstsq(basis, line, rcond=None)[0], line)
    assert natural_basis([4], 10).shape == (1, 0)
    assert natural_basis([4, 9], 10).shape == (2, 1)


def test_extraction_rounds_before_the_complement(spark):
    df = spark.createDataFrame(
        [
            ("vs_type2CV_v2_0:13", math.log(0.12345), 0.1),
            ("vs_type2CV_v3_31+_BNT162b2", math.log(0.5), 0.2),
            ("vs_type2CV_v3_31+_CV", 0.0, 1.0),
            ("vs_type2AZ_v2_0:13", 0.0, 1.0),
            ("sexoM", 0.0, 1.0),
            ("vs_type2CV_v1_0:6", None, None),
        ],
        "term string, estimate double, std_error double",
    )
    got = {r["term"]: r for r in extract_ve(df).collect()}
    assert set(got) == {"v2_0:13", "v3_31+_BNT162b2", "v1_0:6"}
    assert got["v2_0:13"]["ve"] == 87.7
    assert got["v2_0:13"]["ve_ci"] == "87.7% (85.0-89.9)"
    assert got["v1_0:6"]["ve_ci"] is None
    assert [got[t]["term_rank"] for t in ("v1_0:6", "v2_0:13", "v3_31+_BNT162b2")] == [1, 4, 15]


def test_figure_frame(spark):
    sheet = spark.createDataFrame(
        [
            ("Overall", "vs_type2CV_v2_181+", 0.4, 0.3, 0.5),
            ("80+", "vs_type2CV_v3_31+_BNT162b2", 0.8, 0.7, 0.9),
            ("sensibilidade", "vs_type2CV_v2_181+", 0.1, 0.0, 0.2),
            ("Overall", "vs_type2CV_v1_0:6", 0.1, 0.0, 0.2),
        ],
        "id string, term string, VE double, Lower double, Upper double",
    )
    got = ve_figure_frame({"1": sheet}).orderBy("id_rank").collect()
    assert [(r["id"], r["term"], r["id_rank"]) for r in got] == [
        ("Overall", "181+", 1), ("≥80", "31+_BNT162b2", 4),
    ]
    assert C.exposure_terms()[got[0]["term_rank"] - 1] == "v2_181+"


def test_aliased_columns(spark, rows):
    twins = [(*r[:3], "11" if r[0] == "AZ_v1_14+" else "35", *r[4:]) for r in rows]
    df = spark.createDataFrame(twins, FRAME)
    got = terms(fit_logit(df, ["vs_type2", "uf"], smooths=[]))
    plain = terms(fit_logit(df, ["vs_type2"], smooths=[]))
    assert got["uf11"]["estimate"] is None and got["uf11"]["converged"] and got["uf11"]["reason"] == "aliased"
    for name, row in plain.items():
        assert got[name]["estimate"] == pytest.approx(row["estimate"], abs=1e-6)
        assert got[name]["std_error"] == pytest.approx(row["std_error"], abs=1e-6)


def working_reml(x, y, beta, penalties, strengths):
    """Restricted log-likelihood of the working model at ``beta``, up to a constant."""
    mu = 1 / (1 + np.exp(-x @ beta))
    w = mu * (1 - mu)
    z = x @ beta + (y - mu) / w
    total = x.T @ (x * w[:, None]) + sum(s * p for s, p in zip(strengths, penalties))
    hat = np.linalg.solve(total, x.T @ (w * z))
    fit = np.sum(w * (z - x @ hat) ** 2) + sum(s * hat @ p @ hat for s, p in zip(strengths, penalties))
    ranks = [np.linalg.matrix_rank(p) for p in penalties]
    return -0.5 * fit - 0.5 * np.linalg.slogdet(total)[1] + 0.5 * sum(r * math.log(s) for r, s in zip(ranks, strengths))


def test_penalised_fit_is_the_reml_optimum(spark, rows):
    """Solve the same model by brute force: Newton for the coefficients, a grid for the strengths."""
    got = terms(fit_logit(spark.createDataFrame(rows, FRAME), ["vs_type2", "sexo"]))
    days, ages = sorted({r[7] for r in rows}), sorted({r[8] for r in rows})
    s_day, s_age = natural_spline(days), natural_spline(ages)
    of_day, of_age = dict(zip(days, s_day.basis)), dict(zip(ages, s_age.basis))
    names = ["CV_v2_0:13", "CV_v2_181+", "AZ_v1_14+"]
    x = np.array([[1.0, *[float(r[0] == n) for n in names], float(r[2] == "M"), *of_day[r[7]], *of_age[r[8]]] for r in rows])
    y = np.array([r[-1] for r in rows], dtype=float)
    first, second = np.zeros((23, 23)), np.zeros((23, 23))
    first[5:14, 5:14], second[14:, 14:] = s_day.penalty, s_age.penalty

    def fit(strengths):
        beta = np.zeros(23)
        for _ in range(30):
            mu = 1 / (1 + np.exp(-x @ beta))
            total = x.T @ (x * (mu * (1 - mu))[:, None]) + strengths[0] * first + strengths[1] * second
            beta = beta + np.linalg.solve(total, x.T @ (y - mu) - (strengths[0] * first + strengths[1] * second) @ beta)
        return beta, np.sqrt(np.diag(np.linalg.inv(total)))

    strengths = np.array([1.0, 1.0])
    for _ in range(8):  # alternate the working model and a coordinate search over it
        beta, error = fit(strengths)
        for _ in range(3):
            for j in (0, 1):
                grid = [np.where(np.arange(2) == j, s, strengths) for s in 10 ** np.linspace(-6, 8, 281)]
                strengths = max(grid, key=lambda g: working_reml(x, y, beta, [first, second], g))
    beta, error = fit(strengths)
    for i, term in enumerate(["(Intercept)", *[f"vs_type2{n}" for n in names], "sexoM"]):
        assert got[term]["converged"]
        assert got[term]["estimate"] == pytest.approx(beta[i], abs=2e-3)
        assert got[term]["std_error"] == pytest.approx(error[i], abs=2e-4)


def test_penalty_is_the_integrated_squared_second_derivative():
    values = list(range(0, 400))
    spline = natural_spline(values, 8)
    coefficients = np.random.default_rng(1).normal(size=spline.basis.shape[1])
    curve = spline.basis @ coefficients
    step = 1 / (len(values) - 1)
    second = np.diff(curve, 2) / step**2
    assert coefficients @ spline.penalty @ coefficients == pytest.approx(np.sum(second**2) * step, rel=0.02)


def test_an_unfinished_fit_publishes_no_numbers(spark, rows):
    df = spark.createDataFrame(rows, FRAME)
    got = fit_logit(df, ["vs_type2", "sexo"], smooths=[], max_steps=1).collect()
    assert got and all(r["estimate"] is None and not r["converged"] and r["reason"] == "not_converged" for r in got)


def test_one_sided_levels_say_why(spark, rows):
    lonely = [("CV_v1_0:6", "No-Prev-Infected", "F", "35", "0", 0, 0, 10, 30, 5, 0), ("CV_v1_7:13", "No-Prev-Infected", "F", "35", "0", 0, 0, 10, 30, 2, 2)]
    got = terms(fit_logit(spark.createDataFrame([*rows, *lonely], FRAME), ["vs_type2", "sexo"], smooths=[]))
    assert {t: r["reason"] for t, r in got.items() if r["estimate"] is None} == {
        "vs_type2CV_v1_0:6": "no_cases", "vs_type2CV_v1_7:13": "no_controls",
    }


def crossed(cells, smooth=False):
    """Rows of (exposure, sex, cases, controls); other covariates constant, or days and ages spread."""
    rows, k = [], 0
    for label, sex, cases, controls in cells:
        for case in [1] * cases + [0] * controls:
            k += 1
            when, age = (k * 7 % 60, 20 + k * 5 % 40) if smooth else (0, 30)
            rows.append((label, "No-Prev-Infected", sex, "35", "0", 0, 0, when, age, 1, case))
    return rows


#: Every level has cases and controls, but (late, F) has cases only and (uv, M) controls only.
TORN = [("uv", "F", 30, 40), ("CV_v2_181+", "F", 12, 0), ("uv", "M", 0, 9), ("CV_v2_181+", "M", 25, 20), ("AZ_v1_14+", "F", 9, 11)]


@pytest.mark.parametrize("smooths", [[], ["date_year", "idade"]])
def test_separation_by_two_factors(spark, smooths):
    df = spark.createDataFrame(crossed(TORN, bool(smooths)), FRAME)
    got = terms(fit_logit(df, ["vs_type2", "sexo"], smooths=smooths))
    reasons = {t: r["reason"] for t, r in got.items()}
    assert reasons == {"(Intercept)": None, "vs_type2CV_v2_181+": "separated", "sexoM": "separated", "vs_type2AZ_v1_14+": None}
    kept = [c for c in TORN if c[:2] not in (("CV_v2_181+", "F"), ("uv", "M"))]
    if not smooths:
        assert got["vs_type2AZ_v1_14+"]["estimate"] == pytest.approx(math.log(9 / 11) - math.log(30 / 40), abs=1e-6)
        rest = terms(fit_logit(spark.createDataFrame(crossed(kept), FRAME), ["vs_type2", "sexo"], smooths=[]))
        assert got["vs_type2AZ_v1_14+"]["std_error"] == pytest.approx(rest["vs_type2AZ_v1_14+"]["std_error"], abs=1e-6)


def test_large_but_finite_effects_are_not_separated(spark, monkeypatch):
    from caselink.models import penalised

    monkeypatch.setattr(penalised, "SUSPECT", 0.5)
    cells = [("uv", "F", 30, 2), ("CV_v2_181+", "F", 2, 60), ("uv", "M", 9, 3), ("CV_v2_181+", "M", 1, 20)]
    df = spark.createDataFrame(crossed(cells), FRAME)
    got = terms(fit_logit(df, ["vs_type2", "sexo"], smooths=[]))
    assert all(r["converged"] and r["reason"] is None for r in got.values())
    assert got["vs_type2CV_v2_181+"]["estimate"] < -4


def test_separation_without_a_hint(spark):
    """The search itself, from patterns, against brute force over small whole directions."""
    from itertools import product as every

    from caselink.models.margins import Layout
    from caselink.models.separation import separating_directions

    layout = Layout(("a", "b"), (("0", "1", "2"), ("0", "1")), 0)
    rng = np.random.default_rng(6)
    rows, truth = [], {}
    for fit in range(6):
        cells = {(a, b): (int(rng.integers(0, 3)), int(rng.integers(0, 3))) for a in range(3) for b in range(2)}
        here = [(fit, a + 1, b + 1, cases + controls, cases) for (a, b), (cases, controls) in cells.items() if cases + controls]
        rows += here
        truth[fit] = False
        for d in every((-1, 0, 1, -2, 2), repeat=4):
            reach = [(d[0] + (d[1] if a == 2 else d[2] if a == 3 else 0) + (d[3] if b == 2 else 0), n, c) for _, a, b, n, c in here]
            right = all((v == 0) if 0 < c < n else (v >= 0 if c == n else v <= 0) for v, n, c in reach)
            truth[fit] |= right and any(v for v, _, _ in reach)
    columns = [0, layout.entry("a", "1"), layout.entry("a", "2"), layout.entry("b", "1")]
    spans = {k: np.eye(layout.entries)[:, columns] for k in truth}
    frame = spark.createDataFrame(rows, "fit int, f0 int, f1 int, n bigint, cases bigint")
    found = separating_directions(frame, layout, spans)
    assert {k: k in found for k in truth} == truth and len(set(truth.values())) == 2


def test_cross_products_equal_the_dense_ones(spark):
    from caselink.models.margins import Layout, logit_products

    rng = np.random.default_rng(3)
    layout = Layout(("a", "b", "c"), (("x", "y", "z"), ("p", "q"), ("k",)), 3)
    rows, dense = [], []
    for _ in range(400):
        fit, a, b, c = int(rng.integers(2)), int(rng.integers(1, 4)), int(rng.integers(1, 3)), 0
        basis, n = rng.normal(size=3), int(rng.integers(1, 5))
        cases = int(rng.integers(0, n + 1))
        rows.append((fit, a, b, c, basis.tolist(), n, cases))
        x = np.zeros(layout.entries)
        x[[0, layout.offsets[0] + a, layout.offsets[1] + b]] = 1
        x[layout.smooth_offset :] = basis
        dense.append((fit, x, n, cases))
    coefficients = rng.normal(size=(2, layout.entries)) / 3
    spreads = np.array([m @ m.T / 50 for m in rng.normal(size=(2, layout.entries, layout.entries))])
    absent = layout.offsets  # code 0: a fit without the factor has nothing there
    coefficients[:, absent] = 0
    spreads[:, absent] = 0
    spreads[:, :, absent] = 0
    frame = spark.createDataFrame(rows, "fit int, f0 int, f1 int, f2 int, b array<double>, n bigint, cases bigint")
    for given in (None, spreads):
        made = logit_products(frame, layout, coefficients, given)
        for fit in (0, 1):
            x, n, cases = (np.array([d[i] for d in dense if d[0] == fit], float) for i in (1, 2, 3))
            eta = x @ coefficients[fit]
            p = 1 / (1 + np.exp(-eta))
            if given is not None:
                h = n * p * (1 - p) * np.einsum("ij,jk,ik->i", x, given[fit], x)
                n, cases = n + h, cases + h / 2
            w = n * p * (1 - p)
            real = np.ones(layout.entries, bool)
            real[layout.offsets[2]] = False  # the code of a factor that the fits do not have
            block = np.ix_(real, real)
            assert np.allclose(made[fit].matrix[block], (x.T @ (x * w[:, None]))[block])
            assert np.allclose(made[fit].response[real], (x.T @ (w * eta + cases - n * p))[real])
            assert made[fit].deviance == pytest.approx(-2 * float(cases @ np.log(p) + (n - cases) @ np.log1p(-p)))


def test_no_python_runs_beside_the_driver(spark):
    from caselink.models.margins import Layout, dot, entry_sums, quadratic

    layout = Layout(("a",), (("x", "y"),), 2)
    frame = spark.createDataFrame([(0, 1, [0.5, 1.0], 3, 1)], "fit int, f0 int, b array<double>, n bigint, cases bigint")
    ones = np.ones((1, layout.entries))
    sums = {"p": dot(layout, ones), "q": quadratic(layout, np.ones((1, layout.entries, layout.entries)))}
    plan = entry_sums(frame, layout, sums)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "from_json" not in plan.split("== Optimized Logical Plan ==")[1]  # constants, not parsed by row


def test_fits_of_a_batch_equal_single_ones(spark, rows):
    from caselink.models import FitSpec, fit_all
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, FRAME)
    specs = [
        FitSpec({"m": "old"}, F.col("idade") >= 40, ("vs_type2", "sexo")),
        FitSpec({"m": "all"}, None, ("vs_type2", "prev_infected"), ("idade",)),
        FitSpec({"m": "plain"}, F.col("date_year") < 50, ("vs_type2", "sexo"), ()),
        FitSpec({"m": "none"}, F.col("idade") > 1000, ("vs_type2", "sexo")),
    ]
    fitted = fit_all(df, specs)
    together = {(r["m"], r["term"]): r for r in fitted.keyed(fitted.terms(spark)).collect()}
    for spec in specs[:3]:
        chosen = df.where(spec.condition())
        alone = terms(fit_logit(chosen, list(spec.factors), list(spec.smooths)))
        assert {t for m, t in together if m == spec.key["m"]} == set(alone)
        for term, row in alone.items():
            assert together[spec.key["m"], term]["estimate"] == pytest.approx(row["estimate"], abs=1e-9)
            assert together[spec.key["m"], term]["std_error"] == pytest.approx(row["std_error"], abs=1e-9)
    assert not [t for m, t in together if m == "none"]


def test_scores_balance_also_where_records_are_separated(spark, rows):
    from caselink.models import FitSpec, scores

    young = [(*r[:5], int(i % 3 == 0), int(i % 4 == 0), *r[7:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(young, FRAME)
    got = scores(df, [FitSpec({}, None, ("vs_type2", "sexo"), pregnancy=True)]).collect()
    assert {r["factor"] for r in got} == {"vs_type2", "sexo", "puerpera", "gestante"}
    assert all(r["fitted"] == pytest.approx(r["observed"], abs=1e-6) for r in got)
    torn = scores(spark.createDataFrame(crossed(TORN), FRAME), [FitSpec({}, None, ("vs_type2", "sexo"), ())]).collect()
    table = {(r["factor"], r["level"]): (r["records"], r["observed"], round(r["fitted"], 6)) for r in torn}
    assert table["sexo", "M"] == (54, 25, 25.0) and table["vs_type2", "CV_v2_181+"] == (57, 37, 37.0)


def firth(x, y):
    """Newton for Jeffreys' prior with the leverages spelt out, damped."""
    beta = np.zeros(x.shape[1])
    for _ in range(4000):
        p = 1 / (1 + np.exp(-x @ beta))
        w = p * (1 - p)
        covariance = np.linalg.inv(x.T @ (x * w[:, None]))
        h = w * np.einsum("ij,jk,ik->i", x, covariance, x)
        beta = beta + 0.3 * covariance @ (x.T @ (y - p + h * (0.5 - p)))
    return beta, np.sqrt(np.diag(covariance))


def test_bias_reduced_fit_has_all_levels(spark):
    cells = [*TORN, ("CV_v1_0:6", "F", 0, 7), ("CV_v1_0:6", "M", 0, 1)]
    rows = crossed(cells)
    got = terms(fit_logit(spark.createDataFrame(rows, FRAME), ["vs_type2", "sexo"], smooths=[], bias_reduced=True))
    names = ["CV_v2_181+", "AZ_v1_14+", "CV_v1_0:6"]
    x = np.array([[1.0, *[float(r[0] == n) for n in names], float(r[2] == "M")] for r in rows])
    beta, error = firth(x, np.array([r[-1] for r in rows], float))
    for i, term in enumerate(["(Intercept)", *[f"vs_type2{n}" for n in names], "sexoM"]):
        assert got[term]["converged"] and got[term]["reason"] is None
        assert got[term]["estimate"] == pytest.approx(beta[i], abs=1e-6)
        assert got[term]["std_error"] == pytest.approx(error[i], abs=1e-6)


@pytest.mark.parametrize("reduced", [False, True])
def test_cross_products_from_combinations_equal_the_dense_ones(spark, reduced):
    """Two fits with curves of their own, one without the second factor and the second smooth."""
    from caselink.models.margins import Layout, fitted_sums, logit_products

    rng = np.random.default_rng(8)
    curves = (rng.normal(size=(2, 7, 3)), rng.normal(size=(2, 5, 2)))
    curves[1][1] = 0
    layout = Layout(("a", "b"), (("x", "y", "z"), ("p", "q")), 5, curves)
    rows, dense = [], []
    for _ in range(500):
        fit, a, when, age, n = int(rng.integers(2)), int(rng.integers(1, 4)), int(rng.integers(7)), int(rng.integers(5)), int(rng.integers(1, 5))
        b, cases = (0 if fit else int(rng.integers(1, 3))), int(rng.integers(0, n + 1))
        basis = np.concatenate([curves[0][fit, when], curves[1][fit, age]])
        rows.append((fit, a, b, when, age, basis.tolist(), n, cases))
        x = np.zeros(layout.entries)
        x[[0, layout.offsets[0] + a]] = 1
        if b:
            x[layout.offsets[1] + b] = 1
        x[layout.smooth_offset :] = basis
        dense.append((fit, x, n, cases))
    coefficients = rng.normal(size=(2, layout.entries)) / 3
    spreads = np.array([m @ m.T / 50 for m in rng.normal(size=(2, layout.entries, layout.entries))])
    coefficients[:, layout.offsets] = 0
    spreads[:, layout.offsets] = 0
    spreads[:, :, layout.offsets] = 0
    frame = spark.createDataFrame(rows, "fit int, f0 int, f1 int, p0 int, p1 int, b array<double>, n bigint, cases bigint")
    made = logit_products(frame, layout, coefficients, spreads if reduced else None)
    fitted = {(r.fit, r.entry): r.fitted for r in fitted_sums(frame, layout, coefficients, spreads if reduced else None).collect()}
    for fit in (0, 1):
        x, n, cases = (np.array([d[i] for d in dense if d[0] == fit], float) for i in (1, 2, 3))
        eta = x @ coefficients[fit]
        p = 1 / (1 + np.exp(-eta))
        h = n * p * (1 - p) * np.einsum("ij,jk,ik->i", x, spreads[fit], x) if reduced else 0 * n
        expected = n * p - h * (0.5 - p)
        n, cases = n + h, cases + h / 2
        w = n * p * (1 - p)
        real = np.ones(layout.entries, bool)
        real[layout.offsets] = False
        block = np.ix_(real, real)
        assert np.allclose(made[fit].matrix[block], (x.T @ (x * w[:, None]))[block])
        assert np.allclose(made[fit].response[real], (x.T @ (w * eta + cases - n * p))[real])
        assert made[fit].deviance == pytest.approx(-2 * float(cases @ np.log(p) + (n - cases) @ np.log1p(-p)))
        assert fitted[fit, 0] == pytest.approx(float(expected.sum()))


def test_sums_are_made_before_records_are_multiplied(spark):
    from caselink.models.margins import Layout, fitted_sums

    layout = Layout(("a", "b"), (("x", "y"), ("p", "q")), 0)
    frame = spark.createDataFrame([(0, 1, 2, 3, 1)], "fit int, f0 int, f1 int, n bigint, cases bigint")
    ones = np.ones((1, layout.entries))
    plan = fitted_sums(frame, layout, ones)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("EXP(")  # the step below is the earlier one


def test_a_record_is_multiplied_by_its_smooths_only(spark):
    from caselink.models.margins import Layout, _by_combination
    from pyspark.sql import functions as F

    layout = Layout(("a", "b"), (("x", "y"), ("p", "q")), 2, (np.ones((1, 4, 1)), np.ones((1, 3, 1))))
    rows = [(0, 1 + i % 2, 1 + i // 2 % 2, i % 4, i % 3, [1.0, 1.0], 1.0, 1.0, 1.0) for i in range(60)]
    frame = spark.createDataFrame(rows, "fit int, f0 int, f1 int, p0 int, p1 int, b array<double>, w double, r double, d double")
    summed = _by_combination(frame, layout)
    assert summed.agg(F.sum("w")).first()[0] == 60 * 3
    assert summed.where("key >= 0").count() == 4 and summed.where("key < 0").count() == 7


def test_numbering_the_smooths_values_moves_no_record(spark, rows, monkeypatch):
    """An exchange by fit and value would part the records of a combination of levels, which lie in one file."""
    from caselink.models import fit

    plans = {}

    def kept(df, name, *rest):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return df

    monkeypatch.setattr(fit, "savepoint", kept)
    coded = spark.createDataFrame([(0, 1, r[7], r[8], r[9], r[10]) for r in rows[:300]], "fit int, f0 int, s0 int, s1 int, n bigint, cases bigint")
    framed, _, curves = fit._with_basis(coded, [fit.FitSpec()], [0], fit.SMOOTHS, 4)
    assert plans["framed"].count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plans["framed"]
    assert framed.count() == 300 and len(curves) == 2
