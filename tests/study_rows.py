"""Schemas and short forms of study records for the tests."""

from __future__ import annotations

import re
from datetime import date, timedelta

from caselink import config as C

LAB_SCHEMA = (
    "rec_id bigint, id_vigvac bigint, dt_notificacao date, dt_coleta date, dt_inicio_sintomas date, "
    "idade int, sexo string, raca int, confirmado string, cod_ibge string, tipo_teste string, "
    "dt_interna_dt date, evolucao string, dt_evoluca date, gestante int, puerpera int, diabetes int, "
    "obesidade int, imunossupressao int, dcardiaca int, drc int, sistema string"
)
VACC_SCHEMA = (
    "id_vigvac bigint, d_idade int, d1_data_aplicacao date, d2_data_aplicacao date, "
    "d3_data_aplicacao date, d1_nome_vacina string, d2_nome_vacina string, d3_nome_vacina string"
)
DAY0 = date(1996, 1, 1)


def day(offset: int | None) -> date | None:
    return None if offset is None else DAY0 + timedelta(days=offset)


def person_tests(person: int, *results: tuple[int, str], **extra) -> list[dict]:
    """Short form: (day, 'C' or 'N') tests of one person."""
    names = {"C": "Confirmado", "N": "Negativo"}
    return [
        {"id_vigvac": person, "dt_coleta": d, "confirmado": names[r], **extra} for d, r in results
    ]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|\w+)", text)


def crowd(lab, vacc, size=400):
    """One person with a third of all records, many of them on the same few days."""
    tests = []
    for i in range(size):
        person = 7 if i % 3 == 0 else 100 + i % 60
        on = (i * 13) % 120 if person == 7 else (i * 37) % 900
        case = (i // 3) % 5 == 0 if person == 7 else (i + person) % 3 == 0
        tests.append(
            {
                "id_vigvac": person,
                "dt_coleta": on if i % 11 else None,
                "dt_notificacao": on,
                "dt_inicio_sintomas": on - i % 4,
                "confirmado": C.CASE if case else C.CONTROL,
                "idade": 16 + i % 70 if person != 7 else 50,
                "cod_ibge": "350001" if i % 17 else None,
                "dt_interna_dt": on + i % 40 if i % 6 == 0 else None,
                "evolucao": str(1 + i % 3) if i % 6 == 0 else None,
                "dt_evoluca": on + i % 70 if i % 6 == 0 else None,
            }
        )
    doses = [
        {"id_vigvac": p, "d1_data_aplicacao": p % 90, "d2_data_aplicacao": 60 + p % 90 if p % 2 else None,
         "d1_nome_vacina": C.CORONAVAC, "d2_nome_vacina": C.CORONAVAC if p % 2 else None}
        for p in [7, *range(100, 140)]
    ]
    return lab(tests), vacc(doses)
