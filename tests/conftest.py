from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from caselink import build_session  # noqa: E402
from caselink.session import release  # noqa: E402
from study_rows import LAB_SCHEMA, VACC_SCHEMA, day  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture
def lab(spark):
    """Test records from short dicts; days are offsets from a common start."""

    def make(records: list[dict]):
        names = [part.split()[0] for part in LAB_SCHEMA.split(", ")]
        rows = []
        for i, given in enumerate(records, start=1):
            row = {
                "rec_id": i, "id_vigvac": 1, "dt_coleta": 0, "idade": 40, "sexo": "F", "raca": 1,
                "confirmado": "Negativo", "cod_ibge": "350001", "tipo_teste": "RT-PCR", "sistema": "sg",
                **{f: 0 for f in ("gestante", "puerpera", "diabetes", "obesidade", "imunossupressao", "dcardiaca", "drc")},
                **given,
            }
            row.setdefault("dt_notificacao", row["dt_coleta"])
            row.setdefault("dt_inicio_sintomas", row["dt_coleta"])
            for name in names:
                if name.startswith("dt_") and isinstance(row.get(name), int):
                    row[name] = day(row[name])
            rows.append(tuple(row.get(name) for name in names))
        return spark.createDataFrame(rows, LAB_SCHEMA)

    return make


@pytest.fixture
def vacc(spark):
    def make(records: list[dict]):
        names = [part.split()[0] for part in VACC_SCHEMA.split(", ")]
        rows = []
        for given in records:
            row = {"id_vigvac": 1, "d_idade": 40, **given}
            for name in names:
                if name.endswith("aplicacao") and isinstance(row.get(name), int):
                    row[name] = day(row[name])
            rows.append(tuple(row.get(name) for name in names))
        return spark.createDataFrame(rows, VACC_SCHEMA)

    return make
