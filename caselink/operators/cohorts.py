"""Study cohorts cut from the analysis table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselink import config as C
from caselink.functions import age_band


def cohort_conditions() -> dict[str, Column]:
    """Row conditions of the cohorts; controls stay in all of them."""
    pcr = F.col("tipo_teste") == C.PCR
    not_mild = F.col("outcome_confirmado") != "Outpatient_Positive"
    case, control = F.col("confirmado") == C.CASE, F.col("confirmado") == C.CONTROL
    admitted = F.col("hosp_event") == "Hospitalization"
    died = F.col("death_event") == "Death-related"
    return {
        "Infection": pcr,
        "Severe": pcr & not_mild,
        "Hosp": pcr & not_mild & ((admitted & case) | control),
        "Death": pcr & not_mild & ((died & case) | control),
        "Infection_antigen": F.lit(True),
        "Severe_antigen": not_mild,
    }


COHORT_COLUMNS = ["tipo_teste", "outcome_confirmado", "hosp_event", "death_event"]


def cohort_flags(df: DataFrame) -> DataFrame:
    """One boolean column per cohort."""
    return df.withColumns(cohort_conditions())


def with_age_groups(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "idade_cat": age_band("idade", C.MODEL_BANDS),
            "idade_10": age_band("idade", C.DECADE_BANDS),
        }
    )


def expand_cohorts(counts: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Repeat each row once per cohort it belongs to. Meant for aggregated frames."""
    conditions = cohort_conditions()
    wanted = names or list(conditions)
    members = F.array_compact(F.array(*[F.when(conditions[n], F.lit(n)) for n in wanted]))
    return counts.withColumn("cohort", F.explode(members))
