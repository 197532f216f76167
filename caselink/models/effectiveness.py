"""Vaccine-effectiveness tables from logistic fits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink import config as C
from caselink.functions import label_map
from caselink.models.fit import ADJUSTMENT, PREGNANCY, Fitted, FitSpec, fit_all
from caselink.operators.cohorts import cohort_conditions
from caselink.operators.reshape import tagged_union
from caselink.operators.tables import Z_95

OUTCOMES = ["Infection", "Severe", "Death", "Hosp"]
AGE_GROUPS = [label for _, label in C.MODEL_BANDS]
LADDER = {
    "minimal": ["vs_type2", "sexo"],
    "medium": ["vs_type2", "prev_infected", "sexo"],
    "ms": [*ADJUSTMENT, *PREGNANCY],
    "full": [*ADJUSTMENT, *PREGNANCY, "raca"],
}
ANTIGEN = ["Infection_antigen", "Severe_antigen"]


def extract_ve(terms: DataFrame, product: str = "CV", booster: str = "BNT", prefix: str = "vs_type2") -> DataFrame:
    """Effectiveness in percent from log odds ratios, in reporting order.

    The odds ratio and its limits are rounded to three digits first; the upper effectiveness limit
    comes from the lower odds-ratio limit. Other columns, such as why an estimate is null, stay.
    """
    name = f"{prefix}{product}"
    term = F.col("term")
    reported = F.when(term.contains("_v3_"), term.contains(booster)).otherwise(F.lit(True))
    order = {t: rank for rank, t in enumerate(C.exposure_terms(), start=1)}

    def effectiveness(estimate):
        return (1 - F.round(F.exp(estimate), 3)) * 100

    margin = Z_95 * F.col("std_error")
    keys = [c for c in terms.columns if c not in ("term", "estimate", "std_error")]
    return (
        terms.where(term.contains(name) & reported)
        .withColumns(
            {
                "term": F.regexp_replace("term", f"^{name}_", ""),
                "ve": effectiveness(F.col("estimate")),
                "ve_lower": effectiveness(F.col("estimate") + margin),
                "ve_upper": effectiveness(F.col("estimate") - margin),
            }
        )
        .select(
            *keys,
            "term",
            label_map("term", order).cast("bigint").alias("term_rank"),
            *[F.round(c, 1).alias(c) for c in ("ve", "ve_lower", "ve_upper")],
            F.when(
                F.col("ve_lower").isNotNull(),
                F.format_string("%.1f%% (%.1f-%.1f)", "ve", "ve_lower", "ve_upper"),
            ).alias("ve_ci"),
        )
    )


def _in_cohort(cohort: str, age_group: str | None = None):
    inside = cohort_conditions()[cohort]
    return inside if age_group is None else inside & (F.col("idade_cat") == age_group)


def main_spec(
    cohort: str | None = None,
    age_group: str | None = None,
    references: dict[str, str] | None = None,
    key: dict[str, str] | None = None,
) -> FitSpec:
    """The main model of a cohort; pregnancy terms only if someone is young enough for them."""
    where = None if cohort is None else _in_cohort(cohort, age_group)
    return FitSpec(key or {}, where, tuple(ADJUSTMENT), references=references or {}, pregnancy=True)


def outcome_specs(cohorts: Sequence[str] = tuple(OUTCOMES), references: dict[str, str] | None = None) -> list[FitSpec]:
    """One main model per cohort, all ages."""
    return [main_spec(c, None, references, {"outcome": c}) for c in cohorts]


def age_specs(cohorts: Sequence[str] = tuple(OUTCOMES), references: dict[str, str] | None = None) -> list[FitSpec]:
    """One main model per cohort and age group."""
    return [main_spec(c, a, references, {"outcome": c, "idade_cat": a}) for c in cohorts for a in AGE_GROUPS]


def ladder_specs(cohort: str = "Infection") -> list[FitSpec]:
    """Four nested adjustment sets for one cohort."""
    return [FitSpec({"mod": mod}, _in_cohort(cohort), tuple(factors)) for mod, factors in LADDER.items()]


def reference_specs(reference: str = "CV_v2_181+") -> list[FitSpec]:
    """Main models against a late second dose instead of no vaccination, overall and by age group."""
    cohorts = ["Infection", "Severe", *ANTIGEN]
    references = {"vs_type2": reference}
    overall = [main_spec(c, None, references, {"outcome": c, "idade_cat": "Overall"}) for c in cohorts]
    return overall + age_specs(cohorts, references)


def single_specs(cohorts: Sequence[str] = tuple(OUTCOMES), by_age_group: bool = False) -> list[FitSpec]:
    """Exposure alone, per cohort and, if asked, age group."""
    groups = AGE_GROUPS if by_age_group else [None]
    return [
        FitSpec({"cohort": c, **({"idade_cat": a} if a else {})}, _in_cohort(c, a), ("vs_type2",), ())
        for c in cohorts
        for a in groups
    ]


def _keyed_terms(fitted: Fitted, patterns: DataFrame) -> DataFrame:
    return fitted.keyed(fitted.terms(patterns.sparkSession))


def ve_model(patterns: DataFrame, references: dict[str, str] | None = None, cohort: str | None = None) -> DataFrame:
    """All terms of the main model, of all records or of a cohort."""
    return _keyed_terms(fit_all(patterns, [main_spec(cohort, None, references)]), patterns)


def effects(patterns: DataFrame, specs: Sequence[FitSpec], bias_reduced: bool = False) -> DataFrame:
    """Effectiveness from each of the models, fitted together."""
    return _keyed_terms(fit_all(patterns, specs, bias_reduced=bias_reduced), patterns).transform(extract_ve)


def by_outcome(
    patterns: DataFrame, cohorts: Sequence[str] = tuple(OUTCOMES), references: dict[str, str] | None = None
) -> DataFrame:
    """Effectiveness per cohort, all ages."""
    return effects(patterns, outcome_specs(cohorts, references))


def by_age(
    patterns: DataFrame, cohorts: Sequence[str] = tuple(OUTCOMES), references: dict[str, str] | None = None
) -> DataFrame:
    """Effectiveness per cohort and age group; all groups are fitted in the same scans."""
    return effects(patterns, age_specs(cohorts, references))


def reference_change(patterns: DataFrame, reference: str = "CV_v2_181+") -> DataFrame:
    """Booster effectiveness against a late second dose instead of no vaccination."""
    return effects(patterns, reference_specs(reference)).where(F.col("term").contains("v3"))


def single_factor(
    patterns: DataFrame, cohorts: Sequence[str] = tuple(OUTCOMES), by_age_group: bool = False, bias_reduced: bool = False
) -> DataFrame:
    """Log odds ratios of fits with exposure alone, per cohort and, if asked, age group.

    They go through the same fit as all models, but have a closed form to be held against.
    """
    fitted = fit_all(patterns, single_specs(cohorts, by_age_group), bias_reduced=bias_reduced)
    contrasts = _keyed_terms(fitted, patterns).where(
        F.col("term").startswith("vs_type2") & (F.col("term") != f"vs_type2{C.NEVER_VACCINATED}")
    )
    return contrasts.select(
        "cohort",
        *(["idade_cat"] if by_age_group else []),
        F.regexp_replace("term", "^vs_type2", "").alias("vs_type2"),
        "estimate",
        "std_error",
    )


def confounder_ladder(patterns: DataFrame, cohort: str = "Infection") -> DataFrame:
    """Exposure terms under four nested adjustment sets, fitted together to one compressed frame."""
    term = F.col("term")
    reported = F.when(term.contains("_v3_"), term.contains("BNT")).otherwise(F.lit(True))
    return (
        _keyed_terms(fit_all(patterns, ladder_specs(cohort)), patterns)
        .where(term.contains("vs_type2CV") & reported)
        .select("mod", "term", "estimate", "std_error", "converged", "reason")
    )


def scores(patterns: DataFrame, specs: Sequence[FitSpec], bias_reduced: bool = False) -> DataFrame:
    """Records, observed and fitted cases per level of every model: its score equations.

    Fitted cases come from the coefficients in a pass over the records. At the maximum they equal the
    observed ones in each level of each unpenalised factor, so the table checks all adjusted fits
    without a second way to fit them. The levels show which terms a fit has, pregnancy among them.
    """
    fitted = fit_all(patterns, specs, bias_reduced=bias_reduced)
    return fitted.keyed(fitted.scores())


def ve_figure_frame(sheets: Mapping[str, DataFrame]) -> DataFrame:
    """Result sheets of several outcomes as one figure table.

    Each frame has ``id`` (sheet), ``term``, ``VE``, ``Lower``, ``Upper``. Sensitivity sheets and
    first-dose terms are left out; terms are ranked in reporting order and relabelled.
    """
    order = {t: r for r, t in enumerate(C.exposure_terms(), start=1)}
    groups = {name: rank for rank, name in enumerate(["Overall", *AGE_GROUPS], start=1)}
    short = F.regexp_replace(F.regexp_replace("term", "^vs_type2CV_", ""), "^(v1_|v2_|v3_)", "")
    label = (
        F.when(short == "BNT162b2", "Booster\n w/ BNT162b2").when(short == "180+", ">180").otherwise(short)
    )
    return (
        tagged_union(sheets, "outcome")
        .where(~F.col("id").contains("sensibilidade") & ~F.col("term").contains("v1_"))
        .select(
            "outcome",
            F.when(F.col("id") == "80+", "≥80").otherwise(F.col("id")).alias("id"),
            label_map("id", groups).cast("bigint").alias("id_rank"),
            label.alias("term"),
            label_map(F.regexp_replace("term", "^vs_type2CV_", ""), order).cast("bigint").alias("term_rank"),
            "VE", "Lower", "Upper",
        )
    )
