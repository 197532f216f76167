"""Study parameters and fixed vocabularies."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date

# ---------------------------------------------------------------------------
# Result, test and product vocabularies of the source registries.
# ---------------------------------------------------------------------------
CASE = "Confirmado"
CONTROL = "Negativo"

POSITIVE_RESULTS = ["Positivo", "Detectável", "Reagente"]
NEGATIVE_RESULTS = ["Negativo", "Não detectável", "Não Reagente"]

PCR = "RT-PCR"
ANTIGEN = "Antígeno"
NOT_TESTED = "Sem teste"

ASTRAZENECA = "Covid-19-AstraZeneca"
COVISHIELD = "Vacina Covid-19 - Covishield"
CORONAVAC = "Covid-19-Coronavac-Sinovac/Butantan"
JANSSEN = "Vacina covid-19 - Ad26.COV2.S - Janssen-Cilag"
PFIZER = "Vacina covid-19 - BNT162b2 - BioNTech/Fosun Pharma/Pfizer"

PRODUCT_CODES = {ASTRAZENECA: "AZ", CORONAVAC: "CV", JANSSEN: "Ad26", PFIZER: "BNT162b2"}
PRODUCT_LABELS = {
    ASTRAZENECA: "ChAdOx1",
    CORONAVAC: "CoronaVac",
    JANSSEN: "Ad26.COV2.S",
    PFIZER: "BNT162b2",
}
CODE_LABELS = {"AZ": "ChAdOx1", "CV": "CoronaVac", "Ad26": "Ad26.COV2.S", "BNT162b2": "BNT162b2"}
NEVER_VACCINATED = "uv"

RACE_CODES = {"Branca": 1, "Preta": 2, "Amarela": 3, "Parda": 4, "Indigena": 5}
RACE_LABELS = {1: "White", 2: "Black", 3: "Asian", 4: "Mixed", 5: "Indigenous"}
SEX_CODES = {"Indefinido": "I", "Feminino": "F", "Masculino": "M"}

# Keywords in the free-text condition field and the flag each one sets.
CONDITION_KEYWORDS = {
    "diabetes": "Diabetes",
    "obesidade": "Obesidade",
    "imunossupressao": "Imunossupressão",
    "dcardiaca": "cardíacas",
    "puerpera": "parto",
    "drc": "renais",
    "gestante": "Gestante",
}
NO_CONDITIONS = "Vazio"
ASYMPTOMATIC = "Assintomático"

COMORBIDITIES = ["diabetes", "obesidade", "imunossupressao", "dcardiaca", "drc"]
FLAGS = ["gestante", "puerpera", *COMORBIDITIES]

# First digit of the municipality code; 4 and 5 follow the study, not the official numbering.
MACRO_REGIONS = {
    "1": "North",
    "2": "Northeast",
    "3": "Southeast",
    "4": "Central-west",
    "5": "South",
}
REGION_LABELS = {
    "Nordeste": "Northeast",
    "Norte": "North",
    "Sudeste": "Southeast",
    "Sul": "South",
    "Centro-oeste": "Central West",
}
MONTHS = {
    "Jan": 1, "Fev": 2, "Mar": 3, "Abr": 4, "Mai": 5, "Jun": 6,
    "Jul": 7, "Ago": 8, "Set": 9, "Out": 10, "Nov": 11, "Dez": 12,
}
MISSING = "(Missing)"

# Days since a dose, inclusive, per number of doses received; None is open-ended.
DOSE_1_BINS = [(0, 6), (7, 13), (14, None)]
DOSE_2_BINS = [(0, 13), (14, 30), (31, 60), (61, 90), (91, 120), (121, 150), (151, 180), (181, None)]
DOSE_3_BINS = [(0, 6), (7, 13), (14, 30), (31, None)]

# Age bands: lower bound (inclusive) and label; the last one is open-ended.
UPTAKE_BANDS = [(None, "12-17"), (18, "18-59"), (60, "60-79"), (80, "80+")]
UPTAKE_BANDS_60 = [(None, "12-17"), (18, "18-59"), (60, "60+")]
MODEL_BANDS = [(18, "18-59"), (60, "60-79"), (80, "80+")]
DECADE_BANDS = [
    (18, "18-29"), (30, "30-39"), (40, "40-49"), (50, "50-59"),
    (60, "60-69"), (70, "70-79"), (80, "80+"),
]

POPULATION = {"12-17": 18092894, "18-59": 128714674, "60-79": 26712827, "80+": 4617408}
POPULATION_60 = {"12-17": 18092894, "18-59": 128714674, "60+": 31330235}
POPULATION_ALL = 178137803
BOOSTED_COURSES = 9395171


def bin_label(dose: int, low: int, high: int | None) -> str:
    return f"v{dose}_{low}+" if high is None else f"v{dose}_{low}:{high}"


def exposure_terms(booster: str = "BNT162b2") -> list[str]:
    """Exposure labels in reporting order, with the booster product appended to dose 3."""
    return (
        [bin_label(1, *b) for b in DOSE_1_BINS]
        + [bin_label(2, *b) for b in DOSE_2_BINS]
        + [f"{bin_label(3, *b)}_{booster}" for b in DOSE_3_BINS]
    )


@dataclass(frozen=True)
class StudyConfig:
    """Dates, gaps and windows of one study; the defaults are those of the original analysis."""

    first_sample: date = date(2020, 2, 20)  # exclusive
    onset_floor: date = date(2021, 1, 17)  # exclusive
    first_dose_1: date = date(2021, 1, 18)
    sample_ceiling: date = date(2021, 12, 9)  # exclusive
    follow_up_end: date = date(2021, 12, 8)
    revised_follow_up_end: date = date(2021, 11, 11)
    time_origin: date = date(2021, 1, 1)

    min_age: int = 18
    max_age: int = 100
    no_pregnancy_above: int = 55
    max_days_to_test: int = 11  # exclusive, onset to sample of a negative
    onset_after_sample: int = 21  # exclusive
    onset_after_notification: int = 14

    false_negative_gap: int = 7
    negative_gap: int = 14
    positive_gap: int = 90
    severe_gap: int = 28
    outcome_window: int = 28
    outcome_window_wide: int = 90

    min_dose_gap: int = 13
    min_vaccine_age: int = 12

    # Exclusive first date of each dose's uptake curve, and the exclusive last date.
    uptake_floor: dict[str, date] = field(
        default_factory=lambda: {
            "d1_data_aplicacao": date(2021, 1, 17),
            "d2_data_aplicacao": date(2021, 2, 1),
            "d3_data_aplicacao": date(2021, 8, 1),
        }
    )
    uptake_ceiling: date = date(2021, 11, 12)
    grid_end: date = date(2021, 11, 11)
    late_product_floor: date = date(2021, 4, 30)  # exclusive, two products licensed later

    series_floor: date = date(2020, 2, 24)  # exclusive, first notification in the epidemic series
    event_floor: date = date(2020, 1, 11)  # exclusive
    event_ceiling: date = date(2021, 11, 12)  # exclusive
    severe_floor: date = date(2020, 2, 11)  # exclusive
    axis_start: date = date(2020, 2, 1)
    axis_end: date = date(2021, 11, 12)
    case_control_start: date = date(2021, 1, 1)  # axis of the case-control histograms
    case_control_end: date = date(2021, 11, 12)

    default_micro_region: str = "530001"
    macro_regions: dict[str, str] = field(default_factory=lambda: dict(MACRO_REGIONS))
    excluded_state: str = "99"

    # The antigen result column is not used for hospital negatives unless asked for.
    use_antigen_result: bool = False
    # Persons never vaccinated have no exposure status and count as vaccinated here unless asked.
    null_status_unvaccinated: bool = False

    def revised(self) -> StudyConfig:
        """The revision of the study, which ends follow-up earlier."""
        return replace(self, follow_up_end=self.revised_follow_up_end)
