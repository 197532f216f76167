"""Vaccination records: consistency, product names, time since dose, exposure labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselink import config as C
from caselink.config import StudyConfig
from caselink.functions import days_between, label_map, paste

DOSES = ["d1_data_aplicacao", "d2_data_aplicacao", "d3_data_aplicacao"]


def vaccinated_persons(df: DataFrame) -> DataFrame:
    """Persons with a first dose, the two brand names of one product merged for doses 1 and 2."""
    merged = {
        c: F.when(F.col(c) == C.COVISHIELD, C.ASTRAZENECA).otherwise(F.col(c))
        for c in ["d1_nome_vacina", "d2_nome_vacina"]
    }
    return df.where(F.col("d1_data_aplicacao").isNotNull()).withColumns(merged)


def inconsistency_flag(cfg: StudyConfig, check_age: bool = False) -> Column:
    """1 for doses too close, a dose before the campaign, or two products in the primary course."""
    d1, d2 = F.col("d1_data_aplicacao"), F.col("d2_data_aplicacao")
    first, second = F.col("d1_nome_vacina"), F.col("d2_nome_vacina")
    bad = (
        F.when(days_between(d2, d1) < cfg.min_dose_gap, 1)
        .when(d1 < F.lit(cfg.first_dose_1), 1)
        .when(second.isNotNull() & (second != first), 1)
    )
    if check_age:
        bad = bad.when(F.col("d_idade") < cfg.min_vaccine_age, 1)
    return bad.otherwise(0)


def vaccine_consistency(df: DataFrame, cfg: StudyConfig, check_age: bool = False) -> DataFrame:
    """Consistent vaccination records only."""
    return df.withColumn("flag_incon", inconsistency_flag(cfg, check_age)).where(
        F.col("flag_incon") == 0
    )


def recode_products(df: DataFrame) -> DataFrame:
    """Short product codes; no first dose reads ``uv``, unknown names are null."""
    codes = {f"d{k}_nome_vacina": label_map(f"d{k}_nome_vacina", C.PRODUCT_CODES) for k in (1, 2, 3)}
    first = F.col("d1_nome_vacina")
    codes["d1_nome_vacina"] = F.when(first.isNull(), C.NEVER_VACCINATED).otherwise(
        codes["d1_nome_vacina"]
    )
    return df.withColumns(codes)


def coded_vaccination(vacc: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Persons vaccinated, flagged for consistency and with product codes: one row each."""
    return (
        vacc.transform(vaccinated_persons)
        .withColumn("flag_incon", inconsistency_flag(cfg))
        .transform(recode_products)
    )


def join_vaccination(tests: DataFrame, coded: DataFrame) -> DataFrame:
    """Each test with its person's record; unvaccinated persons are consistent and read ``uv``.

    ``coded`` holds one row per person, so the join never multiplies tests, and the recodes run once
    per person. The join reuses the partitioning by person the windows left behind.
    """
    unmatched = F.col("flag_incon").isNull()
    return tests.join(coded, "id_vigvac", "left").withColumns(
        {
            "d1_nome_vacina": F.when(unmatched, C.NEVER_VACCINATED).otherwise(F.col("d1_nome_vacina")),
            "flag_incon": F.coalesce("flag_incon", F.lit(0)),
        }
    )


def days_since_dose(df: DataFrame) -> DataFrame:
    """Days from each dose to symptom onset; negative before the dose."""
    return df.withColumns(
        {
            f"days_vacc_{k}_test": days_between("dt_inicio_sintomas", f"d{k}_data_aplicacao")
            for k in (1, 2, 3)
        }
    )


def _bin_of(days: Column, dose: int, bins: list[tuple[int, int | None]]) -> Column:
    """Label of the bin holding a non-negative number of days.

    Looked up in a literal array with one label per day up to the open-ended bin. That keeps the
    expression small: filters on labels copy it into the scan side many times over.
    """
    last = bins[-1][0]
    labels = [
        C.bin_label(dose, low, high)
        for low, high in bins
        for _ in range(low, (last if high is None else high) + 1)
    ]
    return F.get(F.lit(labels), F.least(days, F.lit(last)))


def vacc_status(df: DataFrame) -> DataFrame:
    """Exposure bin at symptom onset.

    A test before the booster is placed by the earlier doses, and one before the first dose is
    unvaccinated. Never-vaccinated persons keep a null status.
    """
    days = {k: F.col(f"days_vacc_{k}_test") for k in (1, 2, 3)}
    before_second = days[2].isNull() | (days[2] < 0)
    status = (
        F.when(days[3] >= 0, _bin_of(days[3], 3, C.DOSE_3_BINS))
        .when(days[1] < 0, C.NEVER_VACCINATED)
        .when((days[1] >= 0) & before_second, _bin_of(days[1], 1, C.DOSE_1_BINS))
        .when(days[2] < 0, "test_before_vaccination2")
        .when(days[2] >= 0, _bin_of(days[2], 2, C.DOSE_2_BINS))
    )
    return df.withColumn("vacc_status", status)


def vs_type(df: DataFrame) -> DataFrame:
    """Product-and-bin labels; drops second doses of the one-dose product.

    A null status pastes as ``NA``, so a label is never null; never vaccinated reads ``uv``.
    """
    first, status = F.col("d1_nome_vacina"), F.col("vacc_status")
    never = (first == C.NEVER_VACCINATED) & status.isNull()
    not_yet = first.isin(list(C.PRODUCT_CODES.values())) & (status == C.NEVER_VACCINATED)
    label = F.when(never | not_yet, C.NEVER_VACCINATED).otherwise(paste(first, status))
    boosted = status.startswith("v3_")
    one_dose_twice = (first == "Ad26") & status.startswith("v2_")
    return df.where(~F.coalesce(one_dose_twice, F.lit(False))).withColumns(
        {
            "vs_type": label,
            "vacc_3_type": F.when(boosted, paste(first, "d3_nome_vacina", sep="-")),
            "vs_type2": F.when(boosted, paste(first, status, "d3_nome_vacina")).otherwise(label),
        }
    )


def exposure(df: DataFrame) -> DataFrame:
    """Days since dose, exposure bin and labels."""
    return df.transform(days_since_dose).transform(vacc_status).transform(vs_type)


BOOSTER_GROUPS = ("CV_v3_BNT162b2", "Other Vaccines")


def booster_group() -> Column:
    """Product of a third dose after the two-dose course: the main one, or any other."""
    main, others = BOOSTER_GROUPS
    return F.when(F.col("vs_type2").contains("CV_v3_") & F.col("vs_type2").endswith("_BNT162b2"), main).otherwise(others)


def product_groups(df: DataFrame) -> DataFrame:
    """Broad exposure groups used in tables and plots."""
    label, label2 = F.col("vs_type"), F.col("vs_type2")
    unvaccinated = label == C.NEVER_VACCINATED
    return df.withColumns(
        {
            "vs_type3": F.when(label2.contains("CV_"), "CoronaVac")
            .when(label2 == C.NEVER_VACCINATED, "Unvaccinated")
            .otherwise("Other Vaccines"),
            "vaccinated_unvacc": F.when(unvaccinated, "uv").otherwise("v"),
            "cv_other": F.when(label.contains("CV"), "CoronaVac")
            .when(~unvaccinated, "other vaccines")
            .otherwise("Unvaccinated"),
            "cv_time": F.when(label.contains("CV"), label)
            .when(~unvaccinated, "other vaccines")
            .otherwise("Unvaccinated"),
        }
    )
