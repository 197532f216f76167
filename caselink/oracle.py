"""The queries as SQL over the same tables, written apart from the DataFrame operators.

``STEPS`` holds named intermediate relations in dependency order. ``_sql`` puts in front of a final
select those it needs. Dates are the fixture study's.
"""

from __future__ import annotations

import re

from caselink.sources import CARRIERS, CARRIER_STUDY
from caselink.sources.carriers import input_tables

STEPS: dict[str, str] = {
    name: text.format(**{t: t for t in input_tables(text)}) for name, text in CARRIERS.items()
}
ORACLE: dict[str, str] = {}


def _sql(final: str, given: tuple[str, ...] = ()) -> str:
    """``final`` with the steps it needs, except those that exist as tables (``given``)."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in STEPS:
            if name not in needed and name not in given and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(STEPS[name])

    visit(final)
    with_list = ",\n".join(f"{name} AS ({STEPS[name].strip()})" for name in STEPS if name in needed)
    return (f"WITH {with_list}\n" if with_list else "") + final.strip()


def _names(prefix: str, names: list[str]) -> str:
    return ", ".join(f"{prefix}{n}" for n in names)


# --- test records -----------------------------------------------------------------------------

STEPS["sampled"] = """
SELECT * REPLACE (CASE WHEN dt_coleta IS NULL AND confirmado = 'Confirmado' THEN dt_notificacao ELSE dt_coleta END AS dt_coleta)
FROM lab"""
STEPS["imputed"] = """
SELECT * REPLACE (COALESCE(dt_inicio_sintomas, dt_coleta) AS dt_inicio_sintomas) FROM sampled"""
STEPS["valid_dates"] = "SELECT * FROM imputed WHERE dt_coleta > DATE '1995-01-31'"
STEPS["windowed"] = "SELECT * FROM valid_dates WHERE idade > 17"
STEPS["firstpos"] = """
SELECT id_vigvac, MIN(dt_coleta) AS firstcasedate FROM windowed WHERE confirmado = 'Confirmado' GROUP BY id_vigvac"""
STEPS["floored"] = """
SELECT w.*, f.firstcasedate FROM windowed w LEFT JOIN firstpos f ON w.id_vigvac = f.id_vigvac
WHERE dt_inicio_sintomas > DATE '1995-06-30'"""
STEPS["deduped"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id_vigvac, dt_coleta, confirmado ORDER BY rec_id) AS rn FROM floored)
WHERE rn = 1"""
STEPS["no_false_neg"] = """
SELECT * EXCLUDE (nxt, nxt_dt) FROM (
  SELECT *, lead(confirmado) OVER (PARTITION BY id_vigvac ORDER BY dt_coleta, confirmado, rec_id) AS nxt,
    lead(dt_coleta) OVER (PARTITION BY id_vigvac ORDER BY dt_coleta, confirmado, rec_id) AS nxt_dt FROM deduped)
WHERE NOT (confirmado = 'Negativo' AND COALESCE(nxt, 'Negativo') = 'Confirmado' AND COALESCE(nxt_dt - dt_coleta, 99) <= 7)"""
STEPS["gaps"] = """
SELECT *, dt_coleta - lag(dt_coleta) OVER (PARTITION BY id_vigvac ORDER BY dt_coleta, confirmado, rec_id) AS days_diff_test,
  row_number() OVER (PARTITION BY id_vigvac ORDER BY dt_coleta, dt_interna_dt ASC NULLS LAST, confirmado, rec_id) AS seq_no
FROM no_false_neg"""
STEPS["filled"] = """
SELECT * REPLACE (last_value(dt_interna_dt IGNORE NULLS) OVER w AS dt_interna_dt,
  last_value(evolucao IGNORE NULLS) OVER w AS evolucao, last_value(dt_evoluca IGNORE NULLS) OVER w AS dt_evoluca)
FROM gaps WINDOW w AS (PARTITION BY id_vigvac ORDER BY dt_interna_dt ASC NULLS LAST, dt_coleta, confirmado, rec_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
STEPS["person_size"] = """
SELECT id_vigvac, COUNT(*) AS tests, COUNT(DISTINCT confirmado) AS results FROM filled GROUP BY id_vigvac"""
STEPS["spaced_negatives"] = """
SELECT f.* FROM filled f JOIN person_size s ON f.id_vigvac = s.id_vigvac
WHERE NOT (tests > 1 AND results = 1 AND confirmado = 'Negativo') OR days_diff_test > 14 OR days_diff_test IS NULL"""
STEPS["spaced_same"] = """
SELECT f.* FROM spaced_negatives f JOIN person_size s ON f.id_vigvac = s.id_vigvac
WHERE NOT (tests > 1 AND results = 1 AND confirmado = 'Confirmado') OR days_diff_test > 90 OR days_diff_test IS NULL"""
STEPS["neighbours"] = """
SELECT *, COUNT(*) OVER (PARTITION BY id_vigvac) AS tests, lag(confirmado) OVER w AS prev, lag(confirmado, 2) OVER w AS prev2,
  lead(confirmado) OVER w AS nxt, dt_coleta - lag(dt_coleta) OVER w AS gap, dt_coleta - lag(dt_coleta, 2) OVER w AS gap2,
  lead(dt_coleta) OVER w - dt_coleta AS gap_next
FROM spaced_same WINDOW w AS (PARTITION BY id_vigvac ORDER BY seq_no)"""
STEPS["spaced"] = """
SELECT * EXCLUDE (tests, prev, prev2, nxt, gap, gap2, gap_next) FROM neighbours
WHERE CASE WHEN tests > 1 AND prev = 'Confirmado' AND confirmado = 'Confirmado' THEN gap > 90
  WHEN tests > 2 AND prev2 = 'Confirmado' AND confirmado = 'Confirmado' THEN gap2 > 90
  WHEN tests > 1 AND confirmado = 'Negativo' AND nxt = 'Confirmado' THEN gap_next > 7 OR gap IS NULL
  ELSE TRUE END"""
STEPS["distances"] = """
SELECT *, dt_interna_dt - dt_coleta AS diff_sample_hosp, dt_evoluca - dt_coleta AS diff_sample_death FROM spaced"""
STEPS["events"] = """
SELECT *, CASE WHEN abs(diff_sample_hosp) <= 28 THEN 'Hospitalization' ELSE 'No hospitalization' END AS hosp_event,
  CASE WHEN evolucao IN ('2', '3') AND diff_sample_death BETWEEN 0 AND 28 THEN 'Death-related' ELSE 'No related' END AS death_event,
  CASE WHEN evolucao IN ('2', '3') AND diff_sample_death BETWEEN 0 AND 90 THEN 'Death-related' ELSE 'No related' END AS death_event_sensi
FROM distances"""
STEPS["complete"] = """
SELECT * EXCLUDE (days_diff_test, raca), substr(cod_ibge, 1, 2) AS uf,
  CASE WHEN hosp_event = 'Hospitalization' OR death_event = 'Death-related' THEN 'Hosp_Death' ELSE 'No event' END AS outcome,
  CASE raca WHEN 1 THEN 'White' WHEN 2 THEN 'Black' WHEN 3 THEN 'Asian' WHEN 4 THEN 'Mixed' WHEN 5 THEN 'Indigenous' END AS raca
FROM events WHERE cod_ibge IS NOT NULL AND sexo IS NOT NULL AND idade IS NOT NULL AND dt_coleta IS NOT NULL"""
STEPS["outcomes"] = """
SELECT *, dt_coleta - lag(dt_coleta) OVER (PARTITION BY id_vigvac ORDER BY seq_no) AS days_diff_test FROM complete"""
STEPS["tested"] = """
SELECT * EXCLUDE (tests, prev, nxt, gap_next) FROM (
  SELECT *, COUNT(*) OVER (PARTITION BY id_vigvac) AS tests, lag(confirmado) OVER w AS prev, lead(confirmado) OVER w AS nxt,
    lead(days_diff_test) OVER w AS gap_next FROM outcomes WINDOW w AS (PARTITION BY id_vigvac ORDER BY seq_no))
WHERE CASE WHEN tests > 1 AND outcome = 'Hosp_Death' AND confirmado = 'Negativo' AND prev = 'Confirmado' THEN days_diff_test > 28 OR days_diff_test IS NULL
  WHEN tests > 1 AND outcome = 'Hosp_Death' AND confirmado = 'Negativo' AND nxt = 'Confirmado' THEN gap_next > 28
  ELSE TRUE END"""

# --- vaccination ------------------------------------------------------------------------------

STEPS["vacc_merged"] = """
SELECT * REPLACE (
  CASE WHEN d1_nome_vacina = 'Vacina Covid-19 - Covishield' THEN 'Covid-19-AstraZeneca' ELSE d1_nome_vacina END AS d1_nome_vacina,
  CASE WHEN d2_nome_vacina = 'Vacina Covid-19 - Covishield' THEN 'Covid-19-AstraZeneca' ELSE d2_nome_vacina END AS d2_nome_vacina)
FROM vacc WHERE d1_data_aplicacao IS NOT NULL"""
STEPS["vacc_flagged"] = """
SELECT *, CAST(CASE WHEN d2_data_aplicacao - d1_data_aplicacao < 13 THEN 1 WHEN d1_data_aplicacao < DATE '1995-02-01' THEN 1
    WHEN d2_nome_vacina IS NOT NULL AND d2_nome_vacina <> d1_nome_vacina THEN 1 ELSE 0 END AS BIGINT) AS flag_incon,
  CAST(CASE WHEN d2_data_aplicacao - d1_data_aplicacao < 13 THEN 1 WHEN d1_data_aplicacao < DATE '1995-02-01' THEN 1
    WHEN d2_nome_vacina IS NOT NULL AND d2_nome_vacina <> d1_nome_vacina THEN 1 WHEN d_idade < 12 THEN 1 ELSE 0 END AS BIGINT) AS flag_incon_age
FROM vacc_merged"""


def _code(column: str, uv: bool = False) -> str:
    head = f"WHEN {column} IS NULL THEN 'uv' " if uv else ""
    return (
        f"CASE {head}WHEN {column} = 'Covid-19-AstraZeneca' THEN 'AZ' "
        f"WHEN {column} = 'Covid-19-Coronavac-Sinovac/Butantan' THEN 'CV' "
        f"WHEN {column} = 'Vacina covid-19 - Ad26.COV2.S - Janssen-Cilag' THEN 'Ad26' "
        f"WHEN {column} = 'Vacina covid-19 - BNT162b2 - BioNTech/Fosun Pharma/Pfizer' THEN 'BNT162b2' END"
    )


def _product(column: str) -> str:
    return f"CASE {_code(column)} WHEN 'AZ' THEN 'ChAdOx1' WHEN 'CV' THEN 'CoronaVac' WHEN 'Ad26' THEN 'Ad26.COV2.S' WHEN 'BNT162b2' THEN 'BNT162b2' END"


STEPS["vacc_coded"] = f"""
SELECT * REPLACE ({_code('d1_nome_vacina', uv=True)} AS d1_nome_vacina, {_code('d2_nome_vacina')} AS d2_nome_vacina,
  {_code('d3_nome_vacina')} AS d3_nome_vacina) FROM vacc_flagged"""

# --- exposure ---------------------------------------------------------------------------------

STEPS["joined"] = """
SELECT t.*, COALESCE(v.flag_incon, 0) AS flag_incon, v.* EXCLUDE (id_vigvac, flag_incon, flag_incon_age)
FROM tested t LEFT JOIN vacc_flagged v ON t.id_vigvac = v.id_vigvac"""
STEPS["linked"] = f"""
SELECT * REPLACE (COALESCE(raca, '(Missing)') AS raca, {_code('d1_nome_vacina', uv=True)} AS d1_nome_vacina,
    {_code('d2_nome_vacina')} AS d2_nome_vacina, {_code('d3_nome_vacina')} AS d3_nome_vacina),
  dt_coleta - firstcasedate AS days_first_positive, d1_data_aplicacao - firstcasedate AS days_vacc_from_firstpos,
  CASE WHEN dt_coleta - firstcasedate > 0 THEN 'Prev-Infected' ELSE 'No-Prev-Infected' END AS prev_infected,
  CAST(diabetes + obesidade + imunossupressao + dcardiaca + drc AS BIGINT) AS n_comorb
FROM joined WHERE flag_incon = 0"""
STEPS["dose_days"] = """
SELECT *, dt_inicio_sintomas - d1_data_aplicacao AS days_vacc_1_test, dt_inicio_sintomas - d2_data_aplicacao AS days_vacc_2_test,
  dt_inicio_sintomas - d3_data_aplicacao AS days_vacc_3_test FROM linked"""
STEPS["raw_status"] = """
SELECT *, CASE WHEN days_vacc_3_test BETWEEN 0 AND 6 THEN 'v3_0:6' WHEN days_vacc_3_test BETWEEN 7 AND 13 THEN 'v3_7:13'
  WHEN days_vacc_3_test BETWEEN 14 AND 30 THEN 'v3_14:30' WHEN days_vacc_3_test >= 31 THEN 'v3_31+'
  WHEN d2_data_aplicacao IS NULL AND days_vacc_1_test < 0 THEN 'uv'
  WHEN d2_data_aplicacao IS NULL AND days_vacc_1_test BETWEEN 0 AND 6 THEN 'v1_0:6'
  WHEN d2_data_aplicacao IS NULL AND days_vacc_1_test BETWEEN 7 AND 13 THEN 'v1_7:13'
  WHEN d2_data_aplicacao IS NULL AND days_vacc_1_test >= 14 THEN 'v1_14+'
  WHEN d2_data_aplicacao IS NOT NULL AND days_vacc_1_test < 0 THEN 'before_1'
  WHEN days_vacc_2_test < 0 THEN 'before_2' WHEN days_vacc_2_test <= 13 THEN 'v2_0:13' WHEN days_vacc_2_test <= 30 THEN 'v2_14:30'
  WHEN days_vacc_2_test <= 60 THEN 'v2_31:60' WHEN days_vacc_2_test <= 90 THEN 'v2_61:90' WHEN days_vacc_2_test <= 120 THEN 'v2_91:120'
  WHEN days_vacc_2_test <= 150 THEN 'v2_121:150' WHEN days_vacc_2_test <= 180 THEN 'v2_151:180' WHEN days_vacc_2_test > 180 THEN 'v2_181+' END AS status0
FROM dose_days"""
STEPS["statuses"] = """
SELECT * EXCLUDE (status0), CASE WHEN status0 = 'before_1' THEN 'uv' WHEN status0 = 'before_2' AND days_vacc_1_test <= 6 THEN 'v1_0:6'
  WHEN status0 = 'before_2' AND days_vacc_1_test <= 13 THEN 'v1_7:13' WHEN status0 = 'before_2' THEN 'v1_14+' ELSE status0 END AS vacc_status
FROM raw_status"""
STEPS["typed"] = """
SELECT *, CASE WHEN vs0 IN ('AZ_uv', 'CV_uv', 'Ad26_uv', 'BNT162b2_uv', 'uv_NA') THEN 'uv' ELSE vs0 END AS vs_type,
  CASE WHEN contains(vacc_status, 'v3_') THEN COALESCE(d1_nome_vacina, 'NA') || '-' || COALESCE(d3_nome_vacina, 'NA') END AS vacc_3_type
FROM (SELECT *, COALESCE(d1_nome_vacina, 'NA') || '_' || COALESCE(vacc_status, 'NA') AS vs0 FROM statuses)
WHERE NOT contains(vs0, 'Ad26_v2')"""
STEPS["exposed"] = """
SELECT * EXCLUDE (vs0), CASE WHEN contains(vs_type, 'v3_') THEN vs_type || '_' || COALESCE(d3_nome_vacina, 'NA') ELSE vs_type END AS vs_type2 FROM typed"""
STEPS["dated"] = """
SELECT * FROM exposed WHERE dt_coleta < DATE '2001-07-01' AND dt_coleta + 21 > dt_inicio_sintomas"""
STEPS["usable"] = "SELECT * FROM dated WHERE sexo <> 'I' AND sexo <> 'NA' AND sexo IS NOT NULL AND uf <> '99'"
STEPS["analysis"] = """
SELECT * REPLACE (CAST(CASE WHEN idade > 99 THEN 100 ELSE idade END AS BIGINT) AS idade,
    CAST(CASE WHEN idade > 55 THEN 0 ELSE gestante END AS BIGINT) AS gestante, CAST(CASE WHEN idade > 55 THEN 0 ELSE puerpera END AS BIGINT) AS puerpera,
    CAST(diabetes AS BIGINT) AS diabetes, CAST(obesidade AS BIGINT) AS obesidade, CAST(imunossupressao AS BIGINT) AS imunossupressao,
    CAST(dcardiaca AS BIGINT) AS dcardiaca, CAST(drc AS BIGINT) AS drc, CAST(d_idade AS BIGINT) AS d_idade),
  CASE WHEN vacc_status IN ('uv', 'v1_0:6', 'v1_7:13') THEN 'UVacc' ELSE 'Vacc' END AS psm_vacc,
  dt_inicio_sintomas - DATE '1995-01-01' AS date_year,
  CASE WHEN confirmado = 'Negativo' THEN 'Negative' WHEN outcome = 'Hosp_Death' THEN 'Hosp_Death_Positive' ELSE 'Outpatient_Positive' END AS outcome_confirmado,
  CASE WHEN contains(vs_type2, 'CV_v3_') THEN DATE '2001-06-30' - d3_data_aplicacao END AS length,
  CASE WHEN contains(vs_type2, 'CV_v3_') THEN d3_data_aplicacao - d2_data_aplicacao END AS time_2nd_3rd
FROM usable"""
STEPS["regions"] = """
SELECT regexp_extract(CD_GEOCODI, '[0-9]{6}') AS code, cod_rgi FROM mun_region"""
STEPS["comorb_rank"] = """
SELECT n_comorb, rank() OVER (ORDER BY n DESC) AS rk FROM (SELECT n_comorb, COUNT(*) AS n FROM linked WHERE n_comorb IS NOT NULL GROUP BY n_comorb)"""
STEPS["comorb_levels"] = """
SELECT n_comorb, CASE WHEN rk <= 2 OR (SELECT COUNT(*) FROM comorb_rank WHERE rk > 2) <= 1 THEN CAST(n_comorb AS VARCHAR) ELSE '2+' END AS lumped FROM comorb_rank"""
STEPS["lumped_analysis"] = """
SELECT a.* REPLACE (l.lumped AS n_comorb) FROM analysis a LEFT JOIN comorb_levels l ON a.n_comorb = l.n_comorb"""

ANALYSIS_COLUMNS = [
    "rec_id", "id_vigvac", "seq_no", "dt_notificacao", "dt_coleta", "dt_inicio_sintomas", "idade",
    "sexo", "raca", "confirmado", "cod_ibge", "uf", "tipo_teste", "sistema", "gestante", "puerpera",
    "diabetes", "obesidade", "imunossupressao", "dcardiaca", "drc", "n_comorb", "firstcasedate",
    "days_first_positive", "days_vacc_from_firstpos", "prev_infected", "days_diff_test",
    "dt_interna_dt", "evolucao", "dt_evoluca", "diff_sample_hosp", "diff_sample_death",
    "hosp_event", "death_event", "death_event_sensi", "outcome", "outcome_confirmado", "d_idade",
    "d1_data_aplicacao", "d2_data_aplicacao", "d3_data_aplicacao", "d1_nome_vacina",
    "d2_nome_vacina", "d3_nome_vacina", "flag_incon", "days_vacc_1_test", "days_vacc_2_test",
    "days_vacc_3_test", "vacc_status", "vs_type", "vacc_3_type", "vs_type2", "psm_vacc",
    "date_year", "length", "time_2nd_3rd",
]

# --- cohorts and tables -----------------------------------------------------------------------

IN_COHORT = {
    "Infection": "tipo_teste = 'RT-PCR'",
    "Severe": "tipo_teste = 'RT-PCR' AND outcome_confirmado <> 'Outpatient_Positive'",
    "Hosp": "tipo_teste = 'RT-PCR' AND outcome_confirmado <> 'Outpatient_Positive' AND (hosp_event = 'Hospitalization' OR confirmado = 'Negativo')",
    "Death": "tipo_teste = 'RT-PCR' AND outcome_confirmado <> 'Outpatient_Positive' AND (death_event = 'Death-related' OR confirmado = 'Negativo')",
    "Infection_antigen": "TRUE",
    "Severe_antigen": "outcome_confirmado <> 'Outpatient_Positive'",
}
AGE_GROUP = "CASE WHEN idade < 18 THEN NULL WHEN idade < 60 THEN '18-59' WHEN idade < 80 THEN '60-79' ELSE '80+' END"
AGE_TEN = (
    "CASE WHEN idade < 18 THEN NULL WHEN idade < 30 THEN '18-29' WHEN idade < 40 THEN '30-39' WHEN idade < 50 THEN '40-49' "
    "WHEN idade < 60 THEN '50-59' WHEN idade < 70 THEN '60-69' WHEN idade < 80 THEN '70-79' ELSE '80+' END"
)
GROUP3 = "CASE WHEN contains(vs_type2, 'CV_') THEN 'CoronaVac' WHEN vs_type2 = 'uv' THEN 'Unvaccinated' ELSE 'Other Vaccines' END"
MACRO = "CASE substr(cod_ibge, 1, 1) WHEN '1' THEN 'North' WHEN '2' THEN 'Northeast' WHEN '3' THEN 'Southeast' WHEN '4' THEN 'Central-west' WHEN '5' THEN 'South' END"

STEPS["cohort_rows"] = "\nUNION ALL ".join(
    f"SELECT '{name}' AS cohort, {AGE_GROUP} AS idade_cat, vs_type2, confirmado FROM analysis WHERE {test}"
    for name, test in IN_COHORT.items()
)


def _counts(by_age: bool) -> str:
    keys = "cohort, idade_cat, vs_type2" if by_age else "cohort, vs_type2"
    return f"""
SELECT {keys}, COUNT(*) FILTER (WHERE confirmado = 'Confirmado') AS cases, COUNT(*) FILTER (WHERE confirmado = 'Negativo') AS controls
FROM cohort_rows GROUP BY {keys}"""


STEPS["cc_counts"] = _counts(by_age=False)
STEPS["cc_counts_age"] = _counts(by_age=True)
REPORTED = "(NOT contains(vs_type2, '_v3_') OR contains(vs_type2, 'BNT')) AND (contains(vs_type2, 'CV_') OR contains(vs_type2, 'uv'))"
TERMS = [
    "v1_0:6", "v1_7:13", "v1_14+", "v2_0:13", "v2_14:30", "v2_31:60", "v2_61:90", "v2_91:120",
    "v2_121:150", "v2_151:180", "v2_181+", "v3_0:6_BNT162b2", "v3_7:13_BNT162b2",
    "v3_14:30_BNT162b2", "v3_31+_BNT162b2",
]


def _rank(column: str, prefix: str = "") -> str:
    cases = " ".join(f"WHEN '{prefix}{t}' THEN {i}" for i, t in enumerate(TERMS, start=1))
    return f"CAST(CASE {column} WHEN 'uv' THEN 0 {cases} END AS BIGINT)"


def _exposure_table(by_age: bool) -> str:
    source, groups = ("cc_counts_age", "cohort, idade_cat") if by_age else ("cc_counts", "cohort")
    return _sql(f"""
SELECT {groups}, vs_type2, {_rank('vs_type2', 'CV_')} AS term_rank, stratum, n,
  round(100.0 * n / total, 6) AS row_pct, round(100.0 * n / NULLIF(SUM(n) OVER (PARTITION BY {groups}, stratum), 0), 6) AS col_pct
FROM (SELECT *, cases + controls AS total FROM {source} WHERE {REPORTED}) c
CROSS JOIN LATERAL (VALUES ('Confirmado', cases), ('Negativo', controls), ('Overall', cases + controls)) AS v(stratum, n)""")


def _crude(source: str, groups: str) -> str:
    same = " AND ".join(f"c.{g} = r.{g}" for g in groups.split(", "))
    return f"""
SELECT c.*, r.cases AS ref_cases, r.controls AS ref_controls,
  CASE WHEN least(c.cases, c.controls, r.cases, r.controls) > 0 THEN ln(CAST(c.cases AS DOUBLE) * r.controls / (CAST(c.controls AS DOUBLE) * r.cases)) END AS estimate,
  CASE WHEN least(c.cases, c.controls, r.cases, r.controls) > 0 THEN sqrt(1.0 / c.cases + 1.0 / c.controls + 1.0 / r.cases + 1.0 / r.controls) END AS std_error
FROM {source} c LEFT JOIN {source} r ON {same} AND r.vs_type2 = 'uv' WHERE c.vs_type2 <> 'uv'"""


STEPS["crude"] = _crude("cc_counts", "cohort")
STEPS["crude_age"] = _crude("cc_counts_age", "cohort, idade_cat")
Z = "1.959963984540054"

STEPS["described"] = f"""
SELECT *, {AGE_GROUP} AS idade_cat, {GROUP3} AS vs_type3, {MACRO} AS macro_region,
  CASE WHEN row_number() OVER (PARTITION BY id_vigvac ORDER BY seq_no) = 1 THEN 1 ELSE 0 END AS unique_id FROM lumped_analysis"""


def _baseline(
    source: str, categories: list[str], flags: list[str], numbers: list[str], strata: str = "",
    by: str = "confirmado", by_values: tuple[str, ...] = ("Confirmado", "Negativo"),
) -> str:
    lead = f"{strata}, " if strata else ""
    long = "\nUNION ALL ".join(
        f"SELECT {lead}'{v}' AS variable, CAST({v} AS VARCHAR) AS level, s.stratum FROM {source} CROSS JOIN LATERAL (VALUES ({by}), ('Overall')) AS s(stratum)"
        for v in [*categories, *flags]
    )
    flag_list = ", ".join(f"'{f}'" for f in flags) or "''"
    join_strata = f"AND l.{strata} IS NOT DISTINCT FROM c.{strata}" if strata else ""
    select_strata = f"l.{strata}, " if strata else ""
    categorical = f"""
SELECT {lead}variable, COALESCE(level, 'Unknown') AS level, stratum, n, n_known,
  CASE WHEN level IS NOT NULL THEN round(100.0 * n / NULLIF(n_known, 0), 6) END AS stat
FROM (SELECT *, CAST(COALESCE(SUM(CASE WHEN level IS NOT NULL THEN n END) OVER (PARTITION BY {lead}variable, stratum), 0) AS BIGINT) AS n_known
  FROM (SELECT {select_strata}l.variable, l.level, s.stratum, COALESCE(c.n, 0) AS n
    FROM (SELECT DISTINCT {lead}variable, level FROM long_rows) l CROSS JOIN (VALUES {', '.join(f"('{v}')" for v in (*by_values, 'Overall'))}) AS s(stratum)
    LEFT JOIN (SELECT {lead}variable, level, stratum, COUNT(*) AS n FROM long_rows GROUP BY ALL) c
      ON l.variable = c.variable AND l.level IS NOT DISTINCT FROM c.level AND s.stratum = c.stratum {join_strata}))
WHERE variable NOT IN ({flag_list}) OR level = '1' OR level IS NULL"""
    parts = [categorical]
    for number in numbers:
        for level, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
            parts.append(f"""
SELECT {lead}'{number}' AS variable, '{level}' AS level, s.stratum, COUNT({number}) AS n, COUNT({number}) AS n_known,
  round(CAST(quantile_cont({number}, {p}) AS DOUBLE), 6) AS stat
FROM {source} CROSS JOIN LATERAL (VALUES ({by}), ('Overall')) AS s(stratum) GROUP BY {lead}s.stratum""")
    STEPS["long_rows"] = long
    text = _sql("\nUNION ALL".join(parts))
    del STEPS["long_rows"]
    return text


# --- notifications ----------------------------------------------------------------------------

STEPS["sg_class"] = """
SELECT * FROM (SELECT *, CASE WHEN sg_tipoteste_2 IN ('Antígeno', 'RT-PCR') AND sg_resultadoteste IN ('Positivo', 'Detectável', 'Reagente') THEN 'Confirmado'
  WHEN sg_tipoteste_2 IN ('Antígeno', 'RT-PCR') AND sg_resultadoteste IN ('Negativo', 'Não detectável', 'Não Reagente')
    AND sg_dt_datateste - sg_dt_datainiciosintomas < 11 THEN 'Negativo' END AS sg_confirmado FROM sg_raw)
WHERE sg_confirmado IS NOT NULL"""
KEYWORDS = {
    "diabetes": "Diabetes", "obesidade": "Obesidade", "imunossupressao": "Imunossupressão",
    "dcardiaca": "cardíacas", "puerpera": "parto", "drc": "renais", "gestante": "Gestante",
}
KEYWORD_SQL = ", ".join(
    f"CAST(contains(COALESCE(sg_condicoes, 'Vazio'), '{word}') AS BIGINT) AS {name}"
    for name, word in KEYWORDS.items()
)
STEPS["srag_typed"] = """
SELECT *, CASE WHEN srag_pcr_sars2 IS NOT NULL THEN 'RT-PCR' WHEN srag_an_sars2 IS NOT NULL THEN 'Antígeno'
  WHEN srag_pcr_resul IN ('1', '2', '3', '5') THEN 'RT-PCR' WHEN srag_res_an IN ('1', '2', '3', '5') THEN 'Antígeno'
  WHEN srag_pcr_resul IN ('4', '9') OR srag_an_sars2 IN ('4', '9') THEN 'Sem teste' END AS tipo_teste FROM srag_raw"""
STEPS["srag_dated"] = """
SELECT * REPLACE (CASE WHEN srag_dt_coleta IS NOT NULL THEN srag_dt_coleta
  WHEN tipo_teste IN ('Antígeno', 'RT-PCR') AND srag_dt_pcr IS NOT NULL THEN srag_dt_pcr
  WHEN tipo_teste IN ('Antígeno', 'RT-PCR') AND srag_dt_res_an IS NOT NULL THEN srag_dt_res_an END AS srag_dt_coleta) FROM srag_typed"""
STEPS["srag_class"] = """
SELECT * FROM (SELECT *, CASE WHEN srag_pcr_sars2 = '1' OR srag_an_sars2 = '1' THEN 'Confirmado'
  WHEN srag_dt_coleta - srag_dt_sin_pri < 11 AND srag_pcr_sars2 IS NULL AND srag_an_sars2 IS NULL AND srag_pcr_resul = '2' THEN 'Negativo' END AS srag_confirmado
  FROM srag_dated) WHERE srag_confirmado IS NOT NULL"""


def _is_one(column: str, alias: str) -> str:
    return f"CAST(CASE WHEN {column} = 1 THEN 1 WHEN {column} IS NOT NULL THEN 0 END AS BIGINT) AS {alias}"


STEPS["notifications"] = f"""
SELECT rec_id, id_vigvac, srag_dt_notif AS dt_notificacao, srag_dt_sin_pri AS dt_inicio_sintomas, srag_dt_coleta AS dt_coleta,
  CAST(srag_idade_srag AS BIGINT) AS idade, srag_cs_sexo AS sexo, NULLIF(TRY_CAST(srag_cs_raca AS BIGINT), 9) AS raca,
  srag_confirmado AS confirmado, srag_co_mun_res AS cod_ibge,
  CAST(CASE WHEN srag_cs_gestant IN (1, 2, 3, 4) THEN 1 ELSE 0 END AS BIGINT) AS gestante, {_is_one('srag_puerpera', 'puerpera')},
  {_is_one('srag_diabetes', 'diabetes')}, {_is_one('srag_obesidade', 'obesidade')}, {_is_one('srag_imunodepre', 'imunossupressao')},
  {_is_one('srag_cardiopati', 'dcardiaca')}, {_is_one('srag_renal', 'drc')}, CAST(0 AS BIGINT) AS assintomatico, tipo_teste, 'srag' AS sistema,
  srag_hospital, srag_dt_interna, srag_evolucao, srag_dt_evoluca
FROM srag_class
UNION ALL BY NAME
SELECT rec_id, id_vigvac, sg_dt_datanotificacao AS dt_notificacao, sg_dt_datainiciosintomas AS dt_inicio_sintomas, sg_dt_datateste AS dt_coleta,
  CAST(sg_idade AS BIGINT) AS idade, CASE sg_sexo_2 WHEN 'Indefinido' THEN 'I' WHEN 'Feminino' THEN 'F' WHEN 'Masculino' THEN 'M' END AS sexo,
  CAST(CASE sg_racacor_2 WHEN 'Branca' THEN 1 WHEN 'Preta' THEN 2 WHEN 'Amarela' THEN 3 WHEN 'Parda' THEN 4 WHEN 'Indigena' THEN 5 END AS BIGINT) AS raca,
  sg_confirmado AS confirmado, sg_codigo_ibge_resid AS cod_ibge, {KEYWORD_SQL},
  CAST(contains(sg_sintomas, 'Assintomático') AS BIGINT) AS assintomatico, sg_tipoteste_2 AS tipo_teste, 'sg' AS sistema
FROM sg_class"""
COMORBIDITIES = ["diabetes", "obesidade", "imunossupressao", "dcardiaca", "drc"]
STEPS["person_flags"] = (
    "SELECT id_vigvac, "
    + ", ".join(f"CAST(CASE WHEN SUM({c}) > 0 THEN 1 WHEN SUM({c}) = 0 THEN 0 END AS BIGINT) AS {c}" for c in COMORBIDITIES)
    + " FROM notifications GROUP BY id_vigvac"
)
STEPS["person_race"] = """
SELECT id_vigvac, raca FROM (SELECT *, row_number() OVER (PARTITION BY id_vigvac ORDER BY dt_notificacao, sistema DESC, rec_id) AS rn
  FROM notifications WHERE raca IS NOT NULL) WHERE rn = 1"""
STEPS["featured"] = f"""
SELECT n.* EXCLUDE (raca, {_names('', COMORBIDITIES)}), {_names('f.', COMORBIDITIES)}, r.raca
FROM notifications n LEFT JOIN person_flags f ON n.id_vigvac = f.id_vigvac LEFT JOIN person_race r ON n.id_vigvac = r.id_vigvac"""
STEPS["sg_long"] = "\nUNION ALL ".join(
    f"SELECT id_vigvac, '{k}' AS level, n{k}_sg_dt_datanotificacao AS sg_dt_datanotificacao, n{k}_sg_dt_datateste AS sg_dt_datateste, "
    f"n{k}_sg_resultadoteste AS sg_resultadoteste FROM registry_wide WHERE n{k}_sg_dt_datanotificacao IS NOT NULL"
    for k in range(1, 6)
)

# --- uptake -----------------------------------------------------------------------------------

BAND = "CASE WHEN d_idade < 18 THEN '12-17' WHEN d_idade < 60 THEN '18-59' WHEN d_idade < 80 THEN '60-79' WHEN d_idade >= 80 THEN '80+' END"
BAND_60 = "CASE WHEN d_idade < 18 THEN '12-17' WHEN d_idade < 60 THEN '18-59' WHEN d_idade >= 60 THEN '60+' END"
POP = "CASE faixa_etaria WHEN '12-17' THEN 18092894 WHEN '18-59' THEN 128714674 WHEN '60-79' THEN 26712827 WHEN '80+' THEN 4617408 END"
POP_60 = "CASE faixa_etaria WHEN '12-17' THEN 18092894 WHEN '18-59' THEN 128714674 WHEN '60+' THEN 31330235 END"
STEPS["consistent"] = "SELECT * FROM vacc_flagged WHERE flag_incon_age = 0"
STEPS["doses_given"] = "\nUNION ALL ".join(
    f"SELECT '{dose}' AS dose, {BAND} AS faixa_etaria, d1_nome_vacina = 'Covid-19-Coronavac-Sinovac/Butantan' AS is_cv, {dose} AS data "
    f"FROM consistent WHERE {dose} > DATE '{floor}' AND {dose} < DATE '2001-06-04'"
    for dose, floor in (
        ("d1_data_aplicacao", "1995-01-31"),
        ("d2_data_aplicacao", "1995-02-15"),
        ("d3_data_aplicacao", "1995-08-15"),
    )
)
STEPS["courses"] = f"""
SELECT * FROM (SELECT d1_data_aplicacao, d2_data_aplicacao, d_idade, {_product('d1_nome_vacina')} AS product, {_product('d2_nome_vacina')} AS second
  FROM consistent WHERE d_idade > 11)
WHERE (second <> 'Ad26.COV2.S' OR second IS NULL)
  AND CASE WHEN product LIKE '%Ad26%' OR product LIKE '%BNT%' THEN d1_data_aplicacao > DATE '1995-04-30' ELSE TRUE END"""
STEPS["course_doses"] = """
SELECT product AS d1_nome_vacina, d_idade, 'd1_data_aplicacao' AS dose, d1_data_aplicacao AS data FROM courses
UNION ALL SELECT product, d_idade, 'd2_data_aplicacao', d2_data_aplicacao FROM courses"""
STEPS["product_curves"] = f"""
SELECT *, CAST(SUM(n) OVER (PARTITION BY d1_nome_vacina, dose, faixa_etaria ORDER BY data ASC NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative
FROM (SELECT d1_nome_vacina, dose, {BAND_60} AS faixa_etaria, data, COUNT(*) AS n FROM course_doses GROUP BY ALL)"""
STEPS["boosters"] = f"""
SELECT *, CAST(SUM(n) OVER (PARTITION BY booster ORDER BY data ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative
FROM (SELECT {_product('d3_nome_vacina')} AS booster, d3_data_aplicacao AS data, COUNT(*) AS n FROM consistent
  WHERE d1_nome_vacina = 'Covid-19-Coronavac-Sinovac/Butantan' AND d3_data_aplicacao > DATE '1995-08-15' AND d3_data_aplicacao < DATE '2001-06-03'
  GROUP BY ALL)"""


def _filled(source: str, groups: list[str], value: str, expression: str) -> str:
    """Daily grid per group to the end date, outer-joined to the data, value carried forward."""
    keys = ", ".join(groups)
    match = " AND ".join(f"g.{k} IS NOT DISTINCT FROM d.{k}" for k in [*groups, "data"])
    merged = ", ".join(f"CASE WHEN g.data IS NULL THEN d.{k} ELSE g.{k} END AS {k}" for k in [*groups, "data"])
    return f"""
SELECT {keys}, data, n, cumulative, round(last_value({value} IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY data ROWS UNBOUNDED PRECEDING), 12) AS {value}
FROM (SELECT {merged}, d.n, d.cumulative, d.{value}
  FROM (SELECT {keys}, CAST(unnest(generate_series(first_day, DATE '2001-06-03', INTERVAL 1 DAY)) AS DATE) AS data
        FROM (SELECT {keys}, MIN(data) AS first_day FROM {source} WHERE data IS NOT NULL GROUP BY {keys})) g
  FULL OUTER JOIN (SELECT *, {expression} AS {value} FROM {source} WHERE data IS NOT NULL) d ON {match})"""


# --- epidemic series --------------------------------------------------------------------------

STEPS["notified"] = """
SELECT * FROM imputed WHERE dt_notificacao > DATE '1995-02-04' AND dt_notificacao + 14 >= dt_inicio_sintomas"""
STEPS["infections"] = """
SELECT * FROM notified QUALIFY row_number() OVER (PARTITION BY id_vigvac, dt_coleta, confirmado ORDER BY rec_id) = 1"""
STEPS["admitted"] = """
SELECT * FROM notified QUALIFY row_number() OVER (PARTITION BY id_vigvac, dt_interna_dt, confirmado ORDER BY rec_id) = 1"""
STEPS["died"] = """
SELECT * FROM (SELECT * FROM notified QUALIFY row_number() OVER (PARTITION BY id_vigvac, dt_interna_dt, confirmado ORDER BY dt_evoluca ASC NULLS LAST, rec_id) = 1)
WHERE confirmado = 'Confirmado' AND evolucao IN ('2', '3')"""
STEPS["severe"] = """
SELECT rec_id, id_vigvac, confirmado, dt_interna_dt, evolucao, dt_evoluca, COALESCE(dt_interna_dt, dt_evoluca) AS data_severe
FROM (SELECT * FROM died WHERE id_vigvac NOT IN (SELECT id_vigvac FROM admitted) UNION ALL SELECT * FROM admitted)"""


def _week(column: str) -> str:
    return f"DATE '1970-01-01' + CAST(floor((({column} - DATE '1970-01-01') + 3.5) / 7) * 7 AS INT)"


def _weekly(name: str, source: str, day: str, where: str, end: str) -> str:
    return f"""
SELECT '{name}' AS series, {_week(day)} AS week, COUNT(*) AS n FROM {source}
WHERE {where} AND {day} BETWEEN DATE '1995-02-01' AND DATE '{end}' GROUP BY ALL"""


# --- variants ---------------------------------------------------------------------------------

STEPS["families"] = """
SELECT *, CASE WHEN classificacao = 'Não VOC/VOI' THEN 'Non VOC/VOI' WHEN contains(variante, 'Gama') THEN 'Gamma'
  WHEN contains(variante, 'Delta') THEN 'Delta' ELSE variante END AS family FROM variants"""
STEPS["family_rank"] = """
SELECT family, rank() OVER (ORDER BY q DESC) AS rk FROM (SELECT family, SUM(quantidade) AS q FROM families GROUP BY family)"""
STEPS["lumped_variants"] = """
SELECT make_date(CAST(split_part(periodo, ' ', 2) AS BIGINT), list_position(['Jan','Fev','Mar','Abr','Mai','Jun','Jul','Ago','Set','Out','Nov','Dez'], split_part(periodo, ' ', 1)), 1) AS periodo,
  CASE regiao WHEN 'Nordeste' THEN 'Northeast' WHEN 'Norte' THEN 'North' WHEN 'Sudeste' THEN 'Southeast' WHEN 'Sul' THEN 'South' WHEN 'Centro-oeste' THEN 'Central West' ELSE regiao END AS regiao,
  CASE WHEN rk <= 3 OR (SELECT COUNT(*) FROM family_rank WHERE rk > 3) <= 1 THEN f.family ELSE 'Other' END AS variante, classificacao, quantidade
FROM families f JOIN family_rank r ON f.family = r.family"""

# --- queries ----------------------------------------------------------------------------------

ORACLE["scan_registry"] = """
SELECT o_orderkey AS rec_id, o_custkey AS id_vigvac, CAST(o_orderdate AS DATE) AS dt_notificacao FROM orders WHERE o_orderstatus = 'F'"""
ORACLE["savepoint_roundtrip"] = _sql("SELECT rec_id, id_vigvac, dt_coleta, dt_inicio_sintomas, confirmado FROM imputed")
ORACLE["part_files"] = _sql("SELECT rec_id, dt_coleta, confirmado FROM lab")
ORACLE["tagged_union"] = _sql(
    "SELECT cohort AS id, vs_type2, cases, controls FROM cc_counts WHERE cohort IN ('Infection', 'Severe', 'Hosp', 'Death')"
)
ORACLE["clean_column_names"] = _sql("SELECT periodo, regiao, variante, classificacao, quantidade AS quantidade_n FROM variants")
ORACLE["region_lookup_join"] = _sql(
    "SELECT rec_id, cod_ibge, COALESCE(cod_rgi, '530001') AS cod_rgi FROM lab LEFT JOIN regions ON cod_ibge = code"
)
ORACLE["project_columns"] = _sql("""
SELECT rec_id, id_vigvac, dt_notificacao, dt_coleta, dt_inicio_sintomas, CAST(idade AS BIGINT) AS idade, sexo, CAST(raca AS BIGINT) AS raca, confirmado,
  cod_ibge, tipo_teste, sistema FROM lab""")
ORACLE["wide_to_long_multi"] = _sql("SELECT * FROM sg_long")
ORACLE["dose_unpivot"] = _sql("\nUNION ALL ".join(
    f"SELECT id_vigvac, d1_nome_vacina, CAST(d_idade AS BIGINT) AS d_idade, '{d}' AS dose, {d} AS data FROM vacc"
    for d in ("d1_data_aplicacao", "d2_data_aplicacao", "d3_data_aplicacao")
))
ORACLE["n_comorb"] = _sql(
    "SELECT rec_id, CAST(diabetes + obesidade + imunossupressao + dcardiaca + drc AS BIGINT) AS n_comorb FROM lab"
)
ORACLE["notification_flow"] = _sql("""
SELECT id_vigvac, sg_dt_datanotificacao AS dt_notificacao, 'sg' AS sistema FROM sg_long
UNION ALL SELECT id_vigvac, srag_dt_notif, 'srag' FROM srag_raw""")
ORACLE["harmonise_notifications"] = _sql("SELECT * FROM notifications")
ORACLE["classify_outpatient"] = _sql("SELECT rec_id, sg_confirmado FROM sg_class")
ORACLE["classify_hospital"] = _sql("SELECT rec_id, tipo_teste, srag_dt_coleta, srag_confirmado FROM srag_class")
ORACLE["keyword_flags"] = _sql(f"""
SELECT rec_id, COALESCE(sg_condicoes, 'Vazio') AS sg_condicoes, CAST(contains(sg_sintomas, 'Assintomático') AS BIGINT) AS assintomatico, {KEYWORD_SQL} FROM sg_raw""")
ORACLE["person_comorbidities"] = _sql("SELECT * FROM person_flags")
ORACLE["first_known_value"] = _sql("SELECT * FROM person_race")
ORACLE["person_features"] = _sql("SELECT * FROM featured")
ORACLE["flags_fill_zero"] = _sql(
    "SELECT rec_id, sistema, "
    + ", ".join(f"COALESCE({c}, 0) AS {c}" for c in ["gestante", "puerpera", *COMORBIDITIES])
    + " FROM featured"
)
ORACLE["first_positive"] = _sql(
    "SELECT rec_id, w.id_vigvac, firstcasedate FROM windowed w LEFT JOIN firstpos f ON w.id_vigvac = f.id_vigvac"
)
ORACLE["impute_dates"] = _sql("SELECT rec_id, dt_coleta, dt_inicio_sintomas FROM imputed")
RULE = "rec_id, id_vigvac, dt_coleta, confirmado"
ORACLE["study_window"] = _sql(f"SELECT {RULE}, dt_inicio_sintomas, CAST(idade AS BIGINT) AS idade FROM windowed")
ORACLE["date_consistency"] = _sql(
    "SELECT rec_id, dt_coleta, dt_inicio_sintomas FROM imputed WHERE dt_coleta < DATE '2001-07-01' AND dt_coleta + 21 > dt_inicio_sintomas"
)
ORACLE["complete_case"] = _sql("""
SELECT rec_id, cod_ibge, substr(cod_ibge, 1, 2) AS uf, sexo,
  CASE raca WHEN 1 THEN 'White' WHEN 2 THEN 'Black' WHEN 3 THEN 'Asian' WHEN 4 THEN 'Mixed' WHEN 5 THEN 'Indigenous' END AS raca,
  CAST(idade AS BIGINT) AS idade, dt_coleta FROM lab
WHERE cod_ibge IS NOT NULL AND sexo IS NOT NULL AND idade IS NOT NULL AND dt_coleta IS NOT NULL
  AND sexo NOT IN ('I', 'NA') AND substr(cod_ibge, 1, 2) <> '99'""")
ORACLE["dedup_first"] = _sql(f"SELECT {RULE} FROM deduped")
ORACLE["neg_then_pos"] = _sql(f"SELECT {RULE}, firstcasedate FROM no_false_neg")
ORACLE["days_diff_test"] = _sql(f"SELECT {RULE}, days_diff_test, seq_no FROM gaps")
ORACLE["fill_down"] = _sql("SELECT rec_id, dt_interna_dt, evolucao, dt_evoluca FROM filled")
ORACLE["same_result_gap"] = _sql(f"SELECT {RULE} FROM spaced_same")
ORACLE["mixed_result_gap"] = _sql(f"SELECT {RULE} FROM spaced")
ORACLE["outcome_events"] = _sql("""
SELECT rec_id, diff_sample_hosp, diff_sample_death, hosp_event, death_event, death_event_sensi, outcome, days_diff_test FROM outcomes""")
ORACLE["severe_negative_gap"] = _sql(f"SELECT {RULE}, outcome, uf, raca FROM tested")
ORACLE["vaccine_consistency"] = _sql("SELECT id_vigvac, flag_incon, flag_incon_age FROM vacc_flagged")
ORACLE["join_vaccination"] = _sql("""
SELECT rec_id, id_vigvac, flag_incon, CAST(d_idade AS BIGINT) AS d_idade, d1_data_aplicacao, d2_data_aplicacao, d3_data_aplicacao FROM joined""")
ORACLE["recode_labels"] = _sql("SELECT id_vigvac, d1_nome_vacina, d2_nome_vacina, d3_nome_vacina FROM vacc_coded")
ORACLE["days_since_dose"] = _sql("SELECT rec_id, days_vacc_1_test, days_vacc_2_test, days_vacc_3_test FROM dose_days")
ORACLE["vacc_status"] = _sql("SELECT rec_id, vacc_status FROM statuses")
ORACLE["vs_type"] = _sql("SELECT rec_id, vs_type, vacc_3_type, vs_type2 FROM exposed")
ORACLE["product_groups"] = _sql(f"""
SELECT rec_id, {GROUP3} AS vs_type3, CASE WHEN vs_type = 'uv' THEN 'uv' ELSE 'v' END AS vaccinated_unvacc,
  CASE WHEN contains(vs_type, 'CV') THEN 'CoronaVac' WHEN vs_type <> 'uv' THEN 'other vaccines' ELSE 'Unvaccinated' END AS cv_other,
  CASE WHEN contains(vs_type, 'CV') THEN vs_type WHEN vs_type <> 'uv' THEN 'other vaccines' ELSE 'Unvaccinated' END AS cv_time FROM analysis""")
ORACLE["region_codes"] = _sql(f"SELECT rec_id, cod_ibge, substr(cod_ibge, 1, 2) AS uf, {MACRO} AS macro_region FROM lab")
ORACLE["age_bands"] = _sql(f"""
SELECT rec_id, {AGE_GROUP} AS idade_cat, {AGE_TEN} AS idade_10, {BAND.replace('d_idade', 'idade')} AS faixa_etaria,
  {BAND_60.replace('d_idade', 'idade')} AS faixa_60 FROM lab""")
ORACLE["analysis_table"] = _sql(f"SELECT {_names('', ANALYSIS_COLUMNS)} FROM analysis")
ORACLE["analysis_table_by_person"] = ORACLE["analysis_table"]
ORACLE["prepare_cohort"] = _sql(f"""
SELECT {_names('', ANALYSIS_COLUMNS)}, COALESCE(cod_rgi, '530001') AS cod_rgi FROM lumped_analysis LEFT JOIN regions ON cod_ibge = code""")
ORACLE["analysis_table_revised"] = _sql("""
SELECT rec_id, vacc_status, vs_type, vs_type2, vacc_3_type, CASE WHEN contains(vs_type2, 'CV_v3_') THEN DATE '2001-06-03' - d3_data_aplicacao END AS length,
  time_2nd_3rd FROM analysis""")
LEDGER = [
    ("sample_date", "lab", "valid_dates"), ("adult", "valid_dates", "windowed"), ("onset_floor", "windowed", "floored"),
    ("duplicate", "floored", "deduped"), ("false_negative", "deduped", "no_false_neg"),
    ("negative_spacing", "no_false_neg", "spaced_negatives"), ("positive_spacing", "spaced_negatives", "spaced_same"),
    ("mixed_spacing", "spaced_same", "spaced"), ("complete", "spaced", "complete"), ("severe_negative", "complete", "tested"),
    ("vaccine_consistency", "tested", "linked"), ("one_dose_product", "linked", "exposed"),
    ("date_consistency", "exposed", "dated"), ("valid_categories", "dated", "analysis"),
]
ORACLE["attrition"] = _sql("\nUNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS step_no, '{step}' AS step, (SELECT COUNT(*) FROM {before}) - (SELECT COUNT(*) FROM {after}) AS removed, "
    f"(SELECT COUNT(*) FROM {after}) AS remaining"
    for i, (step, before, after) in enumerate(LEDGER, start=1)
))
ORACLE["cohort_subsets"] = _sql(
    "SELECT rec_id, " + ", ".join(f"({test}) AS {name}" for name, test in IN_COHORT.items()) + " FROM analysis"
)
ORACLE["freq_with_null"] = _sql("\nUNION ALL ".join(
    f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS level, COUNT(*) AS n FROM lab GROUP BY {c}"
    for c in ("confirmado", "raca", "evolucao")
))
ORACLE["exposure_by_outcome"] = _exposure_table(by_age=False)
ORACLE["exposure_by_outcome_age"] = _exposure_table(by_age=True)
ORACLE["crude_or"] = _sql(f"""
SELECT cohort, vs_type2, cases, controls, ref_cases, ref_controls, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error,
  round(exp(estimate), 6) AS odds_ratio, round(exp(estimate - {Z} * std_error), 6) AS or_lower, round(exp(estimate + {Z} * std_error), 6) AS or_upper
FROM crude""")
FITTED = "cohort IN ('Infection', 'Severe', 'Death', 'Hosp')"
ORACLE["ve_single_factor"] = _sql(
    f"SELECT cohort, vs_type2, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error FROM crude WHERE {FITTED}"
)
ORACLE["ve_single_factor_age"] = _sql(
    f"SELECT cohort, idade_cat, vs_type2, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error FROM crude_age WHERE {FITTED}"
)


def _bias_reduced(source: str, groups: str) -> str:
    """With one factor, Jeffreys' prior adds half a case and half a control to every level."""
    return _sql(f"""
SELECT {', '.join(f'x.{g}' for g in groups.split(', '))}, x.vs_type2, round(ln(x.p / (1 - x.p)) - ln(u.p / (1 - u.p)), 6) AS estimate,
  round(sqrt(1 / ((x.cases + x.controls) * x.p * (1 - x.p)) + 1 / ((u.cases + u.controls) * u.p * (1 - u.p))), 6) AS std_error
FROM (SELECT *, (cases + 0.5e0) / (cases + controls + 1) AS p FROM {source}) x
JOIN (SELECT *, (cases + 0.5e0) / (cases + controls + 1) AS p FROM {source} WHERE vs_type2 = 'uv') u USING ({groups})
WHERE x.vs_type2 <> 'uv' AND {FITTED}""")


ORACLE["ve_bias_reduced"] = _bias_reduced("cc_counts", "cohort")
ORACLE["ve_bias_reduced_age"] = _bias_reduced("cc_counts_age", "cohort, idade_cat")
MAIN_TERMS = ["vs_type2", "prev_infected", "sexo", "uf", "n_comorb"]
PREGNANT = ["puerpera", "gestante"]
SCORE_ROUNDS = 8


def _scores(fits: list[tuple[dict, str, str | None, list[str], bool]], reference: str = "uv", one_sided: bool = False) -> str:
    """Records and cases by level in each fit's complete records, less levels of one result only.

    A fit is (keys, cohort, age group, factors, pregnancy terms if someone is 55 or younger). Cases are
    those observed, which the fitted ones of a score equation must equal. Levels of one result go in
    rounds, since a round's records may have been another level's last cases.
    """
    factors = list(dict.fromkeys(f for _, _, _, own, young in fits for f in [*own, *(PREGNANT if young else [])]))
    keys = list(fits[0][0])
    parts = []
    for number, (key, cohort, age, own, young) in enumerate(fits):
        named = ", ".join(f"'{key[k]}' AS {k}" for k in keys)
        inside = IN_COHORT[cohort] + (f" AND {AGE_GROUP} = '{age}'" if age else "")
        is_young = f"(SELECT coalesce(min(idade) <= 55, FALSE) FROM lumped_analysis WHERE {inside})" if young else "FALSE"
        columns = []
        for f in factors:
            if f in own:
                columns.append(f"CAST({f} AS VARCHAR) AS {f}, TRUE AS has_{f}")
            elif young and f in PREGNANT:
                columns.append(f"CAST({f} AS VARCHAR) AS {f}, {is_young} AS has_{f}")
            else:
                columns.append(f"NULL AS {f}, FALSE AS has_{f}")
        parts.append(
            f"SELECT {number} AS fit, {named + ', ' if named else ''}{', '.join(columns)}, CAST(confirmado = 'Confirmado' AS BIGINT) AS y "
            f"FROM lumped_analysis WHERE {inside} AND date_year IS NOT NULL AND idade IS NOT NULL"
        )
    whole = " AND ".join(f"(NOT has_{f} OR {f} IS NOT NULL)" for f in factors)
    both = " AND ".join(f"(NOT has_{f} OR min(y) OVER (PARTITION BY fit, {f}) < max(y) OVER (PARTITION BY fit, {f}))" for f in factors)
    rounds = [f"score_0 AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE {whole})"]
    last = 0
    if not one_sided:
        last = SCORE_ROUNDS
        rounds += [f"score_{i} AS (SELECT * FROM score_{i - 1} QUALIFY {both})" for i in range(1, last + 1)]
    levels = "\nUNION ALL ".join(
        f"SELECT {', '.join([*keys, ''])}'{f}' AS factor, {f} AS level, COUNT(*) AS records, CAST(SUM(y) AS BIGINT) AS observed, "
        f"CAST(SUM(y) AS DOUBLE) AS fitted FROM kept WHERE has_{f} GROUP BY ALL"
        for f in factors
    )
    kept = f"kept AS (SELECT * FROM score_{last} WHERE fit IN (SELECT fit FROM score_{last} WHERE vs_type2 = '{reference}'))"
    body = ",\n".join([*rounds, kept])
    plain = _sql(f"SELECT 1 FROM lumped_analysis")
    return plain[: plain.rindex("SELECT 1")].rstrip() + ",\n" + body + "\n" + levels


OUTCOME_FITS = [({"outcome": c}, c, None, MAIN_TERMS, True) for c in ("Infection", "Severe", "Death", "Hosp")]
AGES = ["18-59", "60-79", "80+"]
CHANGED = ["Infection", "Severe", "Infection_antigen", "Severe_antigen"]
ORACLE["ve_model_scores"] = _scores([({}, "Infection", None, MAIN_TERMS, True)])
ORACLE["ve_by_outcome_scores"] = _scores(OUTCOME_FITS)
ORACLE["ve_by_outcome_bias_reduced_scores"] = _scores(OUTCOME_FITS, one_sided=True)
ORACLE["ve_antigen_scores"] = _scores([({"outcome": c}, c, None, MAIN_TERMS, True) for c in ("Infection_antigen", "Severe_antigen")])
ORACLE["ve_by_age_scores"] = _scores(
    [({"outcome": c, "idade_cat": a}, c, a, MAIN_TERMS, True) for c in ("Infection", "Severe", "Death", "Hosp") for a in AGES]
)
ORACLE["ve_reference_change_scores"] = _scores(
    [({"outcome": c, "idade_cat": "Overall"}, c, None, MAIN_TERMS, True) for c in CHANGED]
    + [({"outcome": c, "idade_cat": a}, c, a, MAIN_TERMS, True) for c in CHANGED for a in AGES],
    reference="CV_v2_181+",
)
ORACLE["ve_confounder_ladder_scores"] = _scores(
    [
        ({"mod": "minimal"}, "Infection", None, ["vs_type2", "sexo"], False),
        ({"mod": "medium"}, "Infection", None, ["vs_type2", "prev_infected", "sexo"], False),
        ({"mod": "ms"}, "Infection", None, [*MAIN_TERMS, *PREGNANT], False),
        ({"mod": "full"}, "Infection", None, [*MAIN_TERMS, *PREGNANT, "raca"], False),
    ]
)
CATEGORIES = [
    "sexo", "raca", "idade_cat", "tipo_teste", "macro_region", "n_comorb", "prev_infected",
    "hosp_event", "death_event", "outcome", "vs_type3",
]
ORACLE["baseline_table"] = _baseline(
    "described", CATEGORIES, ["gestante", "puerpera", *COMORBIDITIES, "unique_id"], ["idade"]
)
ORACLE["baseline_table_strata"] = _baseline("described", ["vs_type3"], [], [], "idade_cat")
STEPS["described_boosted"] = f"""
SELECT *, {AGE_GROUP} AS idade_cat, {MACRO} AS macro_region,
  CASE WHEN ends_with(vs_type2, '_BNT162b2') THEN 'CV_v3_BNT162b2' ELSE 'Other Vaccines' END AS booster,
  CASE WHEN row_number() OVER (PARTITION BY id_vigvac ORDER BY seq_no) = 1 THEN 1 ELSE 0 END AS unique_id
FROM analysis WHERE tipo_teste = 'RT-PCR' AND contains(vs_type2, 'CV_v3_')"""
ORACLE["baseline_table_boosted"] = _baseline(
    "described_boosted",
    ["idade_cat", "sexo", "raca", "tipo_teste", "macro_region", "n_comorb", "prev_infected", "hosp_event", "death_event",
     "outcome", "confirmado"],
    ["gestante", "puerpera", *COMORBIDITIES, "unique_id"], ["idade", "length"],
    by="booster", by_values=("CV_v3_BNT162b2", "Other Vaccines"),
)
STEPS["timed"] = """
SELECT confirmado, CASE WHEN contains(vs_type, 'CV') THEN vs_type WHEN vs_type <> 'uv' THEN 'other vaccines' ELSE 'Unvaccinated' END AS cv_time
FROM analysis WHERE tipo_teste = 'RT-PCR'"""
ORACLE["cv_time_table"] = _baseline("timed", ["cv_time"], [], [])
ORACLE["unique_persons"] = _sql("""
SELECT confirmado AS stratum, COUNT(*) AS records, COUNT(*) FILTER (WHERE rn = 1) AS persons
FROM (SELECT confirmado, row_number() OVER (PARTITION BY id_vigvac ORDER BY seq_no) AS rn FROM analysis) GROUP BY confirmado""")
ORACLE["lump_levels"] = _sql("SELECT rec_id, lumped AS n_comorb FROM linked l LEFT JOIN comorb_levels c ON l.n_comorb = c.n_comorb")
ORACLE["lump_levels_weighted"] = _sql("SELECT * FROM lumped_variants")
ORACLE["weekly_histogram"] = _sql(f"""
SELECT {_week('dt_coleta')} AS week, {GROUP3} AS vs_type3, confirmado, COUNT(*) AS n FROM analysis
WHERE tipo_teste = 'RT-PCR' AND dt_coleta BETWEEN DATE '1995-09-01' AND DATE '2001-06-04' GROUP BY ALL""")
ORACLE["weekly_histogram_all_tests"] = _sql(f"""
SELECT {_week('dt_coleta')} AS week, {GROUP3} AS vs_type3, confirmado, COUNT(*) AS n FROM analysis
WHERE dt_coleta BETWEEN DATE '1995-09-01' AND DATE '2001-06-04' GROUP BY ALL""")
STEPS["first_pcr"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_vigvac ORDER BY seq_no) AS rn FROM analysis WHERE tipo_teste = 'RT-PCR') WHERE rn = 1"""
ORACLE["interval_histogram"] = _sql("""
SELECT CAST(floor((time_2nd_3rd + 3.5) / 7) * 7 AS BIGINT) AS bin, COUNT(*) AS n FROM first_pcr
WHERE d1_nome_vacina = 'CV' AND time_2nd_3rd > 90 AND time_2nd_3rd <= 300 GROUP BY ALL""")
ORACLE["booster_delay_bar"] = _sql(f"""
SELECT days_vacc_3_test, {AGE_GROUP} AS idade_cat, COUNT(*) AS n FROM first_pcr
WHERE contains(vs_type2, 'CV_v3') AND contains(vs_type2, 'BNT') AND days_vacc_3_test BETWEEN 0 AND 60 GROUP BY ALL""")
ORACLE["uptake_daily"] = _sql("SELECT dose, faixa_etaria, is_cv, data, COUNT(*) AS n FROM doses_given GROUP BY ALL")
ORACLE["uptake_cumulative"] = _sql(f"""
SELECT *, round(CAST(cumulative AS DOUBLE) / {POP}, 12) AS coverage FROM (
  SELECT *, CAST(SUM(n) OVER (PARTITION BY course, dose, faixa_etaria ORDER BY data ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM (
    SELECT 'all' AS course, dose, faixa_etaria, data, COUNT(*) AS n FROM doses_given GROUP BY ALL
    UNION ALL SELECT 'CoronaVac', dose, faixa_etaria, data, COUNT(*) FROM doses_given WHERE is_cv GROUP BY ALL))""")
ORACLE["booster_mix"] = _sql(
    _filled("boosters", ["booster"], "share", "CASE WHEN booster IS NOT NULL THEN CAST(cumulative AS DOUBLE) / 9395171 END")
)
ORACLE["uptake_by_product"] = _sql(f"SELECT *, round(CAST(cumulative AS DOUBLE) / {POP_60}, 12) AS coverage FROM product_curves")
ORACLE["uptake_filled"] = _sql(
    _filled("product_curves", ["d1_nome_vacina", "dose", "faixa_etaria"], "coverage", f"CAST(cumulative AS DOUBLE) / {POP_60}")
)
ORACLE["uptake_by_product_all"] = _sql("""
SELECT *, round(CAST(cumulative AS DOUBLE) / 178137803, 12) AS coverage FROM (
  SELECT *, CAST(SUM(n) OVER (PARTITION BY d1_nome_vacina, dose ORDER BY data ASC NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative
  FROM (SELECT d1_nome_vacina, dose, data, COUNT(*) AS n FROM course_doses GROUP BY ALL))""")
ORACLE["second_dose_missing"] = _sql(f"""
SELECT {BAND} AS faixa_etaria, d2_nome_vacina IS NULL AS d2_missing, COUNT(*) AS n FROM vacc_merged
WHERE d1_data_aplicacao > DATE '1995-01-31' AND d1_data_aplicacao < DATE '2001-06-04' AND d1_nome_vacina = 'Covid-19-Coronavac-Sinovac/Butantan' GROUP BY ALL""")
CASES = "confirmado = 'Confirmado'"
ORACLE["epidemic_series"] = _sql("\nUNION ALL ".join([
    _weekly("infection", "infections", "dt_inicio_sintomas", CASES, "2001-06-04"),
    _weekly("hospitalization", "admitted", "dt_interna_dt", f"{CASES} AND dt_interna_dt > DATE '1995-01-11' AND dt_interna_dt < DATE '2001-06-03'", "2001-06-04"),
    _weekly("death", "died", "dt_evoluca", "dt_evoluca > DATE '1995-01-11' AND dt_evoluca < DATE '2001-06-04'", "2001-06-03"),
    _weekly("severe", "severe", "data_severe", f"{CASES} AND data_severe > DATE '1995-02-11' AND data_severe < DATE '2001-06-03'", "2001-06-03"),
]))


def _axis(step: str, months: int) -> str:
    start, end = f"DATE '{CARRIER_STUDY.axis_start}'", f"DATE '{CARRIER_STUDY.axis_end}'"
    return f"""
SELECT '{step}' AS step, CAST(axis AS DATE) AS axis_date, COUNT(l.rec_id) AS n
FROM (SELECT unnest(generate_series({start}, {end}, INTERVAL {months} MONTH)) AS axis)
LEFT JOIN lab l ON l.confirmado = 'Confirmado' AND l.dt_inicio_sintomas BETWEEN {start} AND {end}
  AND l.dt_inicio_sintomas >= axis AND l.dt_inicio_sintomas < axis + INTERVAL {months} MONTH GROUP BY ALL"""


ORACLE["axis_months"] = _sql(f"{_axis('month', 1)}\nUNION ALL {_axis('quarter', 3)}")
ORACLE["severe_outcomes"] = _sql("SELECT * FROM severe")
ORACLE["severe_series_all_results"] = _sql(f"""
SELECT {_week('data_severe')} AS week, COUNT(*) AS n FROM severe
WHERE data_severe > DATE '1995-01-11' AND dt_evoluca < DATE '2001-06-04' AND data_severe BETWEEN DATE '1995-02-01' AND DATE '2001-06-03' GROUP BY ALL""")
ORACLE["variant_share"] = _sql("""
SELECT periodo, regiao, variante, n, round(CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY periodo, regiao), 6) AS share
FROM (SELECT periodo, regiao, variante, CAST(SUM(quantidade) AS BIGINT) AS n FROM lumped_variants GROUP BY ALL)""")
EFFECT = f"""(1 - round(exp(estimate), 3)) * 100 AS ve0, (1 - round(exp(estimate + {Z} * std_error), 3)) * 100 AS lower0,
  (1 - round(exp(estimate - {Z} * std_error), 3)) * 100 AS upper0"""
ORACLE["ve_terms"] = _sql(f"""
SELECT cohort, term, {_rank('term')} AS term_rank, round(ve0, 1) AS ve, round(lower0, 1) AS ve_lower, round(upper0, 1) AS ve_upper,
  CASE WHEN ve0 IS NOT NULL THEN printf('%.1f%% (%.1f-%.1f)', ve0, lower0, upper0) END AS ve_ci
FROM (SELECT cohort, substr(vs_type2, 4) AS term, {EFFECT} FROM crude
  WHERE cohort IN ('Infection', 'Severe') AND starts_with(vs_type2, 'CV_') AND (NOT contains(vs_type2, '_v3_') OR contains(vs_type2, 'BNT')))""")


def _sheet(outcome: str, cohort: str) -> str:
    columns = "round(1 - round(exp(estimate), 3), 6) AS VE, round(1 - round(exp(estimate + {z} * std_error), 3), 6) AS Lower, round(1 - round(exp(estimate - {z} * std_error), 3), 6) AS Upper".format(z=Z)
    return (
        f"SELECT '{outcome}' AS outcome, 'Overall' AS id, vs_type2, {columns} FROM crude WHERE cohort = '{cohort}' AND {REPORTED}\n"
        f"UNION ALL SELECT '{outcome}', CAST(idade_cat AS VARCHAR), vs_type2, {columns} FROM crude_age WHERE cohort = '{cohort}' AND {REPORTED}"
    )


ORACLE["ve_figure_frame"] = _sql(f"""
SELECT outcome, CASE WHEN id = '80+' THEN '≥80' ELSE id END AS id,
  CAST(CASE id WHEN 'Overall' THEN 1 WHEN '18-59' THEN 2 WHEN '60-79' THEN 3 WHEN '80+' THEN 4 END AS BIGINT) AS id_rank,
  CASE substr(vs_type2, 7) WHEN '181+' THEN '181+' ELSE substr(vs_type2, 7) END AS term, {_rank('substr(vs_type2, 4)')} AS term_rank, VE, Lower, Upper
FROM ({_sheet('1', 'Infection')} UNION ALL {_sheet('2', 'Severe')}) WHERE NOT contains(vs_type2, 'v1_')""")
