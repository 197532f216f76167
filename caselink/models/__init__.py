"""Effectiveness models on compressed covariate patterns."""

from caselink.models.effectiveness import (
    age_specs,
    by_age,
    by_outcome,
    confounder_ladder,
    effects,
    extract_ve,
    ladder_specs,
    main_spec,
    outcome_specs,
    reference_change,
    reference_specs,
    scores,
    single_factor,
    ve_figure_frame,
    ve_model,
)
from caselink.models.fit import FitSpec, compress, fit_all, fit_logit

__all__ = [
    "FitSpec",
    "age_specs",
    "by_age",
    "by_outcome",
    "compress",
    "confounder_ladder",
    "effects",
    "extract_ve",
    "fit_all",
    "fit_logit",
    "ladder_specs",
    "main_spec",
    "outcome_specs",
    "reference_change",
    "reference_specs",
    "scores",
    "single_factor",
    "ve_figure_frame",
    "ve_model",
]
