"""Case/control classification and harmonisation of the two notification systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink import config as C
from caselink.config import StudyConfig
from caselink.functions import contains_flag, days_between, label_map
from caselink.operators.reshape import stack_frames

OUTPATIENT_NAMES = {
    "sg_dt_datanotificacao": "dt_notificacao",
    "sg_dt_datainiciosintomas": "dt_inicio_sintomas",
    "sg_dt_datateste": "dt_coleta",
    "sg_sexo_2": "sexo",
    "sg_racacor_2": "raca",
    "sg_idade": "idade",
    "sg_confirmado": "confirmado",
    "sg_codigo_ibge_resid": "cod_ibge",
    "sg_tipoteste_2": "tipo_teste",
}
HOSPITAL_NAMES = {
    "srag_dt_notif": "dt_notificacao",
    "srag_dt_sin_pri": "dt_inicio_sintomas",
    "srag_dt_coleta": "dt_coleta",
    "srag_cs_sexo": "sexo",
    "srag_cs_raca": "raca",
    "srag_idade_srag": "idade",
    "srag_confirmado": "confirmado",
    "srag_co_mun_res": "cod_ibge",
    "srag_diabetes": "diabetes",
    "srag_obesidade": "obesidade",
    "srag_imunodepre": "imunossupressao",
    "srag_cardiopati": "dcardiaca",
    "srag_puerpera": "puerpera",
    "srag_cs_gestant": "gestante",
    "srag_renal": "drc",
}
NOTIFICATION = [
    "rec_id", "id_vigvac", "dt_notificacao", "dt_inicio_sintomas", "dt_coleta", "idade", "sexo",
    "raca", "confirmado", "cod_ibge", *C.FLAGS, "assintomatico", "tipo_teste", "sistema",
]
HOSPITAL_EXTRA = ["srag_hospital", "srag_dt_interna", "srag_evolucao", "srag_dt_evoluca"]


def classify_outpatient(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Add ``sg_confirmado`` and drop tests that are neither a case nor a valid control."""
    tested = F.col("sg_tipoteste_2").isin(C.ANTIGEN, C.PCR)
    delay = days_between("sg_dt_datateste", "sg_dt_datainiciosintomas")
    result = F.col("sg_resultadoteste")
    status = F.when(tested & result.isin(C.POSITIVE_RESULTS), C.CASE).when(
        tested & result.isin(C.NEGATIVE_RESULTS) & (delay < cfg.max_days_to_test), C.CONTROL
    )
    return df.withColumn("sg_confirmado", status).where(F.col("sg_confirmado").isNotNull())


def keyword_flags(df: DataFrame, conditions: str = "sg_condicoes", symptoms: str = "sg_sintomas") -> DataFrame:
    """0/1 flags for condition keywords; a missing condition text counts as none."""
    text = F.coalesce(F.col(conditions), F.lit(C.NO_CONDITIONS))
    flags = {name: contains_flag(text, word) for name, word in C.CONDITION_KEYWORDS.items()}
    return df.withColumns(
        {conditions: text, "assintomatico": contains_flag(symptoms, C.ASYMPTOMATIC), **flags}
    )


def harmonise_outpatient(df: DataFrame) -> DataFrame:
    """Classified outpatient records under the common names."""
    return (
        df.transform(keyword_flags)
        .withColumns(
            {
                "sg_racacor_2": label_map("sg_racacor_2", C.RACE_CODES),
                "sg_sexo_2": label_map("sg_sexo_2", C.SEX_CODES),
                "sistema": F.lit("sg"),
            }
        )
        .withColumnsRenamed(OUTPATIENT_NAMES)
        .select(*NOTIFICATION)
    )


def classify_hospital(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Add ``tipo_teste`` and ``srag_confirmado``, complete the sample date, drop the rest."""
    pcr, antigen = F.col("srag_pcr_sars2"), F.col("srag_an_sars2")
    pcr_result, antigen_result = F.col("srag_pcr_resul"), F.col("srag_res_an")
    read = ["1", "2", "3", "5"]
    unread = ["4", "9"]
    test = (
        F.when(pcr.isNotNull(), C.PCR)
        .when(antigen.isNotNull(), C.ANTIGEN)
        .when(pcr_result.isin(read), C.PCR)
        .when(antigen_result.isin(read), C.ANTIGEN)
        .when(pcr_result.isin(unread) | antigen.isin(unread), C.NOT_TESTED)
    )
    tested = F.col("tipo_teste").isin(C.ANTIGEN, C.PCR)
    sample = F.coalesce("srag_dt_coleta", F.when(tested, F.coalesce("srag_dt_pcr", "srag_dt_res_an")))
    negative = (pcr_result == "2") | (antigen == "2")
    if cfg.use_antigen_result:
        negative = negative | (antigen_result == "2")
    delay = days_between("srag_dt_coleta", "srag_dt_sin_pri")
    status = F.when((pcr == "1") | (antigen == "1"), C.CASE).when(
        (delay < cfg.max_days_to_test) & pcr.isNull() & antigen.isNull() & negative, C.CONTROL
    )
    return (
        df.withColumn("tipo_teste", test)
        .withColumn("srag_dt_coleta", sample)
        .withColumn("srag_confirmado", status)
        .where(F.col("srag_confirmado").isNotNull())
    )


def harmonise_hospital(df: DataFrame) -> DataFrame:
    """Classified hospital records under the common names."""
    race = F.nullif(F.col("srag_cs_raca").try_cast("int"), F.lit(9))
    pregnant = F.when(F.col("srag_cs_gestant").isin(1, 2, 3, 4), 1).otherwise(0)
    flags = [
        "srag_diabetes", "srag_imunodepre", "srag_renal", "srag_obesidade", "srag_cardiopati",
        "srag_puerpera",
    ]
    return (
        df.withColumns({c: (F.col(c) == 1).cast("int") for c in flags})
        .withColumns(
            {
                "srag_cs_raca": race,
                "srag_cs_gestant": pregnant,
                "assintomatico": F.lit(0),
                "sistema": F.lit("srag"),
            }
        )
        .withColumnsRenamed(HOSPITAL_NAMES)
        .select(*NOTIFICATION, *HOSPITAL_EXTRA)
    )


def harmonise_notifications(outpatient: DataFrame, hospital: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Both systems classified, recoded and stacked; hospital-only columns are null for outpatients."""
    return stack_frames(
        hospital.transform(classify_hospital, cfg).transform(harmonise_hospital),
        outpatient.transform(classify_outpatient, cfg).transform(harmonise_outpatient),
    )


def notification_flow(outpatient_long: DataFrame, hospital_long: DataFrame) -> DataFrame:
    """Person, date and system of every notification."""
    return stack_frames(
        outpatient_long.select(
            "id_vigvac",
            F.col("sg_dt_datanotificacao").alias("dt_notificacao"),
            F.lit("sg").alias("sistema"),
        ),
        hospital_long.select(
            "id_vigvac", F.col("srag_dt_notif").alias("dt_notificacao"), F.lit("srag").alias("sistema")
        ),
    )
