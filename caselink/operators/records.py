"""Row-level cleaning of test records: imputation, study window, outcomes, complete cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink import config as C
from caselink.config import StudyConfig
from caselink.functions import days_between, label_map

REQUIRED = ("cod_ibge", "sexo", "idade", "dt_coleta")


def impute_sample_date(df: DataFrame) -> DataFrame:
    """A positive without a sample date takes its notification date."""
    missing = F.col("dt_coleta").isNull() & (F.col("confirmado") == C.CASE)
    return df.withColumn(
        "dt_coleta", F.when(missing, F.col("dt_notificacao")).otherwise(F.col("dt_coleta"))
    )


def impute_onset(df: DataFrame) -> DataFrame:
    """Asymptomatic tests take the sample date as onset."""
    return df.withColumn("dt_inicio_sintomas", F.coalesce("dt_inicio_sintomas", "dt_coleta"))


def impute_dates(df: DataFrame) -> DataFrame:
    return df.transform(impute_sample_date).transform(impute_onset)


def study_window(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Adults sampled after the first valid date, with dates imputed."""
    return (
        df.transform(impute_dates)
        .where(F.col("dt_coleta") > F.lit(cfg.first_sample))
        .where(F.col("idade") >= cfg.min_age)
    )


def onset_floor(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    return df.where(F.col("dt_inicio_sintomas") > F.lit(cfg.onset_floor))


def date_consistency(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Sampled before the ceiling and not implausibly long before onset."""
    return df.where(
        (F.col("dt_coleta") < F.lit(cfg.sample_ceiling))
        & (F.date_add("dt_coleta", cfg.onset_after_sample) > F.col("dt_inicio_sintomas"))
    )


def complete_case(df: DataFrame, columns: Sequence[str] = REQUIRED) -> DataFrame:
    return df.dropna(subset=[*columns])


def valid_categories(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Known sex and a regular state code; nulls drop out."""
    return df.where(
        (F.col("sexo") != "I") & (F.col("sexo") != "NA") & (F.col("uf") != cfg.excluded_state)
    )


def outcome_events(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Link admission and death to the test by their distance in days."""
    to_admission = days_between("dt_interna_dt", "dt_coleta")
    to_death = days_between("dt_evoluca", "dt_coleta")
    died = F.col("evolucao").isin("2", "3")

    def death(window: int):
        related = died & (F.col("diff_sample_death") >= 0) & (F.col("diff_sample_death") <= window)
        return F.when(related, "Death-related").otherwise("No related")

    return (
        df.withColumns({"diff_sample_hosp": to_admission, "diff_sample_death": to_death})
        .withColumns(
            {
                "hosp_event": F.when(
                    F.abs("diff_sample_hosp") <= cfg.outcome_window, "Hospitalization"
                ).otherwise("No hospitalization"),
                "death_event": death(cfg.outcome_window),
                "death_event_sensi": death(cfg.outcome_window_wide),
            }
        )
        .withColumn(
            "outcome",
            F.when(
                (F.col("hosp_event") == "Hospitalization") | (F.col("death_event") == "Death-related"),
                "Hosp_Death",
            ).otherwise("No event"),
        )
    )


def label_records(df: DataFrame) -> DataFrame:
    """State code and race label."""
    return df.withColumns(
        {"uf": F.substring("cod_ibge", 1, 2), "raca": label_map("raca", C.RACE_LABELS)}
    )
