"""Fixture relations: registry-shaped views over the star-schema test tables.

The texts run unchanged on Spark and on an ANSI engine; ``{table}`` marks an input table.
"""

from __future__ import annotations

import string
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from caselink.config import StudyConfig

# Study dates moved to the years the test tables cover.
CARRIER_STUDY = StudyConfig(
    first_sample=date(1995, 1, 31),
    onset_floor=date(1995, 6, 30),
    first_dose_1=date(1995, 2, 1),
    sample_ceiling=date(2001, 7, 1),
    follow_up_end=date(2001, 6, 30),
    revised_follow_up_end=date(2001, 6, 3),
    time_origin=date(1995, 1, 1),
    uptake_floor={
        "d1_data_aplicacao": date(1995, 1, 31),
        "d2_data_aplicacao": date(1995, 2, 15),
        "d3_data_aplicacao": date(1995, 8, 15),
    },
    uptake_ceiling=date(2001, 6, 4),
    grid_end=date(2001, 6, 3),
    late_product_floor=date(1995, 4, 30),
    series_floor=date(1995, 2, 4),
    event_floor=date(1995, 1, 11),
    event_ceiling=date(2001, 6, 4),
    severe_floor=date(1995, 2, 11),
    axis_start=date(1995, 2, 1),
    axis_end=date(2001, 6, 4),
    case_control_start=date(1995, 9, 1),
    case_control_end=date(2001, 6, 4),
)

LAB = """
SELECT o_orderkey AS rec_id, o_custkey AS id_vigvac,
  CAST(o_orderdate AS DATE) AS dt_notificacao,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS dt_coleta,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN CAST(o_orderdate AS DATE) + 25 ELSE CAST(o_orderdate AS DATE) - CAST(o_orderkey % 12 AS INT) END AS dt_inicio_sintomas,
  CAST(15 + o_custkey % 89 AS INT) AS idade,
  CASE WHEN o_custkey % 97 = 0 THEN 'I' WHEN o_custkey % 11 < 6 THEN 'F' ELSE 'M' END AS sexo,
  CASE WHEN o_orderkey % 7 IN (1, 2, 3, 4, 5) THEN CAST(o_orderkey % 7 AS INT) END AS raca,
  CASE WHEN o_custkey % 41 < 4 THEN 'Confirmado' WHEN o_custkey % 41 < 9 THEN 'Negativo'
       WHEN o_orderstatus = 'F' THEN 'Confirmado' ELSE 'Negativo' END AS confirmado,
  CASE WHEN o_orderkey % 501 = 0 THEN NULL WHEN o_orderkey % 503 = 0 THEN '990001' ELSE CAST(110000 + c_nationkey * 17000 + o_custkey % 20 AS VARCHAR(6)) END AS cod_ibge,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'RT-PCR' ELSE 'Antígeno' END AS tipo_teste,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 - 20 AS INT) END AS dt_interna_dt,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(1 + o_orderkey % 3 AS VARCHAR(1)) END AS evolucao,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 110 - 5 AS INT) END AS dt_evoluca,
  CASE WHEN o_custkey % 31 = 0 THEN 1 ELSE 0 END AS gestante,
  CASE WHEN o_custkey % 37 = 0 THEN 1 ELSE 0 END AS puerpera,
  CASE WHEN o_custkey % 13 < 3 THEN 1 ELSE 0 END AS diabetes,
  CASE WHEN o_custkey % 17 < 3 THEN 1 ELSE 0 END AS obesidade,
  CASE WHEN o_custkey % 19 = 0 THEN 1 ELSE 0 END AS imunossupressao,
  CASE WHEN o_custkey % 43 < 4 THEN 1 ELSE 0 END AS dcardiaca,
  CASE WHEN o_custkey % 29 = 0 THEN 1 ELSE 0 END AS drc,
  CASE WHEN o_orderkey % 5 = 0 THEN 'srag' ELSE 'sg' END AS sistema
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

VACC = """
WITH doses AS (
  SELECT DISTINCT o_custkey AS id, CAST(l_shipdate AS DATE) AS dt
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
  WHERE o_custkey % 5 <> 3),
ranked AS (SELECT id, dt, row_number() OVER (PARTITION BY id ORDER BY dt) AS k FROM doses),
wide AS (
  SELECT id, MAX(CASE WHEN k = 1 THEN dt END) AS d1,
    MAX(CASE WHEN k = 2 AND id % 3 >= 1 THEN dt END) AS d2,
    MAX(CASE WHEN k = 3 AND id % 3 = 2 THEN dt END) AS d3
  FROM ranked WHERE k <= 3 GROUP BY id),
prod AS (
  SELECT *, CASE CASE WHEN id % 8 = 4 THEN 9 ELSE id % 4 END WHEN 9 THEN 'Vacina Covid-19 - Covishield' WHEN 0 THEN 'Covid-19-AstraZeneca' WHEN 1 THEN 'Covid-19-Coronavac-Sinovac/Butantan'
    WHEN 2 THEN 'Vacina covid-19 - BNT162b2 - BioNTech/Fosun Pharma/Pfizer'
    ELSE 'Vacina covid-19 - Ad26.COV2.S - Janssen-Cilag' END AS p1 FROM wide)
SELECT id AS id_vigvac, CAST(10 + id % 89 AS INT) AS d_idade,
  d1 AS d1_data_aplicacao, d2 AS d2_data_aplicacao, d3 AS d3_data_aplicacao,
  p1 AS d1_nome_vacina,
  CASE WHEN d2 IS NULL THEN NULL WHEN id % 23 = 0 THEN 'Covid-19-AstraZeneca' ELSE p1 END AS d2_nome_vacina,
  CASE WHEN d3 IS NULL THEN NULL WHEN id % 7 = 0 THEN p1
       ELSE 'Vacina covid-19 - BNT162b2 - BioNTech/Fosun Pharma/Pfizer' END AS d3_nome_vacina
FROM prod
"""


def _slots(count: int) -> str:
    columns = []
    for k in range(1, count + 1):
        columns += [
            f"MAX(CASE WHEN k = {k} THEN dt END) AS n{k}_sg_dt_datanotificacao",
            f"MAX(CASE WHEN k = {k} THEN dt + CAST(k0 % 15 AS INT) END) AS n{k}_sg_dt_datateste",
            f"MAX(CASE WHEN k = {k} THEN res END) AS n{k}_sg_resultadoteste",
        ]
    return ",\n  ".join(columns)


# A row has five slots. A person's records fill as many rows as they need, in order of time.
REGISTRY_WIDE = f"""
WITH base AS (
  SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS dt, o_orderkey AS k0,
    CASE WHEN o_orderstatus = 'F' THEN 'Positivo' WHEN o_orderstatus = 'O' THEN 'Negativo' END AS res
  FROM {{orders}}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dt, k0) AS k FROM base)
SELECT id AS id_vigvac,
  {_slots(5)}
FROM (SELECT id, dt, k0, res, FLOOR((k - 1) / 5) AS block, k - 5 * FLOOR((k - 1) / 5) AS k FROM r)
GROUP BY id, block
"""

SG_RAW = """
SELECT o_orderkey AS rec_id, o_custkey AS id_vigvac, CAST(o_orderdate AS DATE) AS sg_dt_datanotificacao,
  CAST(o_orderdate AS DATE) - CAST(o_orderkey % 9 AS INT) AS sg_dt_datainiciosintomas,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 8 AS INT) AS sg_dt_datateste,
  CASE o_orderkey % 4 WHEN 0 THEN 'RT-PCR' WHEN 1 THEN 'Antígeno' WHEN 2 THEN 'RT-PCR' ELSE 'Sorologia' END AS sg_tipoteste_2,
  CASE o_orderkey % 7 WHEN 0 THEN 'Positivo' WHEN 1 THEN 'Detectável' WHEN 2 THEN 'Reagente' WHEN 3 THEN 'Negativo'
    WHEN 4 THEN 'Não detectável' WHEN 5 THEN 'Não Reagente' END AS sg_resultadoteste,
  CASE o_custkey % 6 WHEN 0 THEN 'Diabetes, Obesidade' WHEN 1 THEN 'Doenças cardíacas crônicas' WHEN 2 THEN 'Gestante'
    WHEN 3 THEN 'Imunossupressão' WHEN 4 THEN 'Doenças renais crônicas' END AS sg_condicoes,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 'Assintomático' ELSE 'Febre, Tosse' END AS sg_sintomas,
  CASE o_custkey % 6 WHEN 0 THEN 'Branca' WHEN 1 THEN 'Preta' WHEN 2 THEN 'Amarela' WHEN 3 THEN 'Parda' WHEN 4 THEN 'Indigena' END AS sg_racacor_2,
  CASE o_custkey % 3 WHEN 0 THEN 'Indefinido' WHEN 1 THEN 'Feminino' ELSE 'Masculino' END AS sg_sexo_2,
  CAST(15 + o_custkey % 89 AS INT) AS sg_idade,
  CAST(110000 + o_custkey % 25 * 17000 + o_custkey % 20 AS VARCHAR(6)) AS sg_codigo_ibge_resid
FROM {orders}
"""

SRAG_RAW = """
SELECT o_orderkey AS rec_id, o_custkey AS id_vigvac, CAST(o_orderdate AS DATE) AS srag_dt_notif,
  CAST(o_orderdate AS DATE) - CAST(o_orderkey % 9 AS INT) AS srag_dt_sin_pri,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 6 AS INT) END AS srag_dt_coleta,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 3 END AS srag_dt_pcr,
  CAST(o_orderdate AS DATE) + 4 AS srag_dt_res_an,
  CASE WHEN o_orderkey % 5 = 0 THEN '1' END AS srag_pcr_sars2,
  CASE WHEN o_orderkey % 11 = 0 THEN '1' END AS srag_an_sars2,
  CAST(1 + o_orderkey % 5 AS VARCHAR(1)) AS srag_pcr_resul,
  CASE o_orderkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' END AS srag_res_an,
  CASE o_custkey % 8 WHEN 7 THEN '9' WHEN 6 THEN NULL ELSE CAST(1 + o_custkey % 5 AS VARCHAR(1)) END AS srag_cs_raca,
  CASE WHEN o_custkey % 4 < 3 THEN CAST(o_custkey % 4 AS INT) END AS srag_diabetes,
  CASE WHEN o_custkey % 7 < 6 THEN CAST(o_custkey % 7 AS INT) END AS srag_cs_gestant,
  CASE WHEN o_custkey % 9 < 3 THEN CAST(o_custkey % 3 AS INT) END AS srag_obesidade,
  CASE WHEN o_orderkey % 10 < 3 THEN CAST(o_orderkey % 3 AS INT) END AS srag_imunodepre,
  CASE WHEN o_orderkey % 11 < 3 THEN CAST(o_orderkey % 3 AS INT) END AS srag_cardiopati,
  CASE WHEN o_custkey % 13 < 3 THEN CAST(o_custkey % 3 AS INT) END AS srag_puerpera,
  CASE WHEN o_orderkey % 14 < 3 THEN CAST(o_orderkey % 3 AS INT) END AS srag_renal,
  CAST(15 + o_custkey % 89 AS INT) AS srag_idade_srag,
  CASE WHEN o_custkey % 3 = 1 THEN 'F' ELSE 'M' END AS srag_cs_sexo,
  CAST(110000 + o_custkey % 25 * 17000 + o_custkey % 20 AS VARCHAR(6)) AS srag_co_mun_res,
  CASE WHEN o_orderkey % 5 = 0 THEN '1' ELSE '2' END AS srag_hospital,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 - 20 AS INT) END AS srag_dt_interna,
  CAST(1 + o_orderkey % 3 AS VARCHAR(1)) AS srag_evolucao,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 110 - 5 AS INT) AS srag_dt_evoluca
FROM {orders}
"""

MUN_REGION = """
SELECT DISTINCT CAST((110000 + c_nationkey * 17000 + c_custkey % 20) * 10 + c_custkey % 20 % 10 AS VARCHAR(7)) AS CD_GEOCODI,
  CAST(110000 + c_nationkey * 17000 + (c_custkey % 20 - c_custkey % 20 % 5) AS VARCHAR(6)) AS cod_rgi
FROM {customer} WHERE c_custkey % 20 <> 19
"""

# Month text, region and lineage names follow the surveillance vocabulary.
VARIANTS = """
WITH monthly AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS mes, r_name, p_type, CAST(SUM(l_quantity) AS BIGINT) AS q
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
    JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3)
SELECT CONCAT(CASE EXTRACT(MONTH FROM mes) WHEN 1 THEN 'Jan' WHEN 2 THEN 'Fev' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Abr'
    WHEN 5 THEN 'Mai' WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Ago' WHEN 9 THEN 'Set' WHEN 10 THEN 'Out'
    WHEN 11 THEN 'Nov' ELSE 'Dez' END, ' ', CAST(EXTRACT(YEAR FROM mes) AS VARCHAR(4))) AS periodo,
  CASE r_name WHEN 'AFRICA' THEN 'Nordeste' WHEN 'AMERICA' THEN 'Norte' WHEN 'ASIA' THEN 'Sudeste' WHEN 'EUROPE' THEN 'Sul' ELSE 'Centro-oeste' END AS regiao,
  CASE WHEN p_type LIKE 'ECONOMY%' THEN CONCAT('Gama ', p_type) WHEN p_type LIKE 'PROMO%' THEN CONCAT('Delta ', p_type) ELSE p_type END AS variante,
  CASE WHEN p_type LIKE 'SMALL%' THEN 'Não VOC/VOI' ELSE 'VOC/VOI' END AS classificacao,
  q AS quantidade
FROM monthly
"""

CARRIERS = {
    "lab": LAB,
    "vacc": VACC,
    "registry_wide": REGISTRY_WIDE,
    "sg_raw": SG_RAW,
    "srag_raw": SRAG_RAW,
    "mun_region": MUN_REGION,
    "variants": VARIANTS,
}


def input_tables(text: str) -> list[str]:
    names = [name for _, name, _, _ in string.Formatter().parse(text) if name]
    return sorted(set(names))


def carrier(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture relation ``name`` over the parquet tables in ``sf_dir``."""
    text = CARRIERS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in input_tables(text)}
    return spark.sql(text, **tables)
