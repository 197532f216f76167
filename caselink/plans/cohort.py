"""From notifications and vaccinations to the analysis table.

Shuffles: one on person, date and result (after a map-side limit to one row per key), one on person
shared by all windows and the vaccination join, and one for the vaccination side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink import config as C
from caselink.config import StudyConfig
from caselink.functions import days_between
from caselink.operators import exposure as E
from caselink.operators import records as R
from caselink.operators import regions
from caselink.operators import window_rules as W
from caselink.operators.levels import lump_levels
from caselink.operators.persons import keep_first
from caselink.operators.reshape import row_sum
from caselink.session import bucketed_stage, shared_stage

OUTPUT = [
    "rec_id", "id_vigvac", "seq_no", "dt_notificacao", "dt_coleta", "dt_inicio_sintomas", "idade",
    "sexo", "raca", "confirmado", "cod_ibge", "uf", "tipo_teste", "sistema", *C.FLAGS, "n_comorb",
    "firstcasedate", "days_first_positive", "days_vacc_from_firstpos", "prev_infected",
    "days_diff_test", "dt_interna_dt", "evolucao", "dt_evoluca", "diff_sample_hosp",
    "diff_sample_death", "hosp_event", "death_event", "death_event_sensi", "outcome",
    "outcome_confirmado", "d_idade", *E.DOSES, "d1_nome_vacina", "d2_nome_vacina",
    "d3_nome_vacina", "flag_incon", "days_vacc_1_test", "days_vacc_2_test", "days_vacc_3_test",
    "vacc_status", "vs_type", "vacc_3_type", "vs_type2", "psm_vacc", "date_year", "length",
    "time_2nd_3rd",
]


def first_tests(lab: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Imputed adult tests, one per person, date and result.

    A key whose records all lie below the onset floor keeps one row. Records above the floor win.
    """
    above_floor = F.col("dt_inicio_sintomas") > F.lit(cfg.onset_floor)
    return (
        lab.transform(R.study_window, cfg)
        .withColumn("_above", above_floor)
        .transform(
            keep_first, ["id_vigvac", "dt_coleta", "confirmado"], [F.col("_above").desc(), "rec_id"]
        )
        .drop("_above")
    )


def distinct_tests(lab: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Tests above the onset floor, one per person, date and result, with the first positive date, which
    counts tests below the floor too."""
    return (
        lab.transform(first_tests, cfg)
        .withColumn("firstcasedate", W.first_positive_in_window())
        .transform(R.onset_floor, cfg)
    )


def tests_by_person(lab: DataFrame, cfg: StudyConfig, root: str | None = None) -> DataFrame:
    """``first_tests`` as a stage bucketed by person, to be given as ``lab`` to the functions here.

    They keep all of its rows and need no exchange on person: for runs under other gaps, windows or
    dates than ``first_sample``, ``min_age`` and ``onset_floor``. A person with very many
    notifications is cut down before the exchange that writes the stage, to two tests a day at most.
    """
    return bucketed_stage(lab.transform(first_tests, cfg), "tests", "id_vigvac", root)


def doses_by_person(vacc: DataFrame, root: str | None = None) -> DataFrame:
    """Vaccinated persons as a stage bucketed alike, to be given as ``vacc``."""
    return bucketed_stage(vacc.transform(E.vaccinated_persons), "doses", "id_vigvac", root)


def without_false_negatives(lab: DataFrame, cfg: StudyConfig) -> DataFrame:
    return lab.transform(distinct_tests, cfg).transform(W.keep_where, W.neg_then_pos(cfg))


def with_gaps(lab: DataFrame, cfg: StudyConfig) -> DataFrame:
    return (
        lab.transform(without_false_negatives, cfg)
        .withColumn("days_diff_test", W.days_diff_test())
        .transform(W.number_tests)
    )


def spaced_same_result(lab: DataFrame, cfg: StudyConfig) -> DataFrame:
    return (
        lab.transform(with_gaps, cfg)
        .transform(W.fill_down)
        .transform(W.keep_where, W.same_result_spacing(cfg))
    )


def spaced_tests(lab: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Tests left after both spacing rules."""
    return lab.transform(spaced_same_result, cfg).transform(
        W.keep_where, W.mixed_result_spacing(cfg)
    )


def linked_outcomes(lab: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Spaced, complete tests with outcomes and labels."""
    return (
        lab.transform(spaced_tests, cfg)
        .transform(R.outcome_events, cfg)
        .transform(R.complete_case)
        .transform(R.label_records)
        .withColumn("days_diff_test", W.days_diff_test(order=["seq_no"]))
    )


def clean_tests(lab: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Valid cases and controls, before vaccination is known."""
    return lab.transform(linked_outcomes, cfg).transform(
        W.keep_where, W.severe_negative_spacing(cfg)
    )


def link_vaccination(tests: DataFrame, vacc: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Tests of persons with consistent vaccination records, with person covariates."""
    return (
        tests.transform(E.join_vaccination, E.coded_vaccination(vacc, cfg))
        .where(F.col("flag_incon") == 0)
        .withColumns(
            {
                "days_first_positive": days_between("dt_coleta", "firstcasedate"),
                "days_vacc_from_firstpos": days_between("d1_data_aplicacao", "firstcasedate"),
                "n_comorb": row_sum(C.COMORBIDITIES),
                "raca": F.coalesce("raca", F.lit(C.MISSING)),
            }
        )
        .withColumn(
            "prev_infected",
            F.when(F.col("days_first_positive") > 0, "Prev-Infected").otherwise("No-Prev-Infected"),
        )
    )


def derived_columns(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Columns of the analysis table that depend on exposure and outcome."""
    severe = F.col("outcome") == "Hosp_Death"
    case = F.col("confirmado") == C.CASE
    status = F.col("vacc_status")
    early = status.isin(C.NEVER_VACCINATED, "v1_0:6", "v1_7:13")
    if cfg.null_status_unvaccinated:
        early = early | status.isNull()
    past_pregnancy = F.col("idade") > cfg.no_pregnancy_above
    boosted = F.col("vs_type2").contains("CV_v3_")
    return df.withColumns(
        {
            "psm_vacc": F.when(early, "UVacc").otherwise("Vacc"),
            "date_year": days_between("dt_inicio_sintomas", F.lit(cfg.time_origin)),
            "outcome_confirmado": F.when(severe & case, "Hosp_Death_Positive")
            .when(~severe & case, "Outpatient_Positive")
            .when(F.col("confirmado") == C.CONTROL, "Negative"),
            "gestante": F.when(past_pregnancy, 0).otherwise(F.col("gestante")),
            "puerpera": F.when(past_pregnancy, 0).otherwise(F.col("puerpera")),
            "length": F.when(
                boosted, days_between(F.lit(cfg.follow_up_end), "d3_data_aplicacao")
            ),
            "time_2nd_3rd": F.when(
                boosted, days_between("d3_data_aplicacao", "d2_data_aplicacao")
            ),
            "idade": F.least("idade", F.lit(cfg.max_age)),
        }
    )


def analysis_rows(linked: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The analysis table without micro-regions; ``n_comorb`` is the plain count."""
    return (
        linked.transform(E.exposure)
        .transform(R.date_consistency, cfg)
        .transform(R.valid_categories, cfg)
        .transform(R.complete_case)
        .transform(derived_columns, cfg)
        .select(*OUTPUT)
    )


def analysis_table(lab: DataFrame, vacc: DataFrame, cfg: StudyConfig) -> DataFrame:
    """One lazy plan from the inputs to the analysis table."""
    return (
        lab.transform(clean_tests, cfg)
        .transform(link_vaccination, vacc, cfg)
        .transform(analysis_rows, cfg)
    )


def prepare_rows(
    lab: DataFrame, vacc: DataFrame, cfg: StudyConfig, root: str | None = None
) -> DataFrame:
    """The analysis table with comorbidity counts lumped.

    The levels need counts over the whole linked table, so that table becomes a stage, which every query
    on the same inputs reads. Otherwise the counts and the final table would each run the rules from the
    raw notifications.
    """
    linked = shared_stage(
        lab.transform(clean_tests, cfg).transform(link_vaccination, vacc, cfg), "linked", root
    )
    return linked.transform(lump_levels, "n_comorb", keep=2, other="2+").transform(
        analysis_rows, cfg
    )


def prepare_cohort(
    lab: DataFrame,
    vacc: DataFrame,
    mun_region: DataFrame,
    cfg: StudyConfig,
    root: str | None = None,
) -> DataFrame:
    """The full preparation, micro-regions included."""
    rows = prepare_rows(lab, vacc, cfg, root)
    return rows.transform(regions.region_lookup_join, mun_region, cfg)


def revise_follow_up(cohort: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The revised table: exposure labels and booster follow-up recomputed to an earlier end date."""
    revised = cfg.revised()
    boosted = F.col("vs_type2").contains("CV_v3_")
    return (
        cohort.transform(E.exposure)
        .transform(R.complete_case)
        .withColumn(
            "length", F.when(boosted, days_between(F.lit(revised.follow_up_end), "d3_data_aplicacao"))
        )
        .withColumn(
            "time_2nd_3rd", F.when(boosted, days_between("d3_data_aplicacao", "d2_data_aplicacao"))
        )
    )
