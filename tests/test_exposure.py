from __future__ import annotations

import pytest
from study_rows import day, person_tests

from caselink import config as C
from caselink.operators import exposure as E
from caselink.plans import cohort as P
from caselink.sources import CARRIER_STUDY as CFG


def status_by_rule(d1, d2, d3):
    """The branch list in words, for days since each dose (None: dose not given)."""
    def label(dose, bins, days):
        for low, high in bins:
            if days >= low and (high is None or days <= high):
                return C.bin_label(dose, low, high)

    if d3 is not None and d3 >= 0:
        return label(3, C.DOSE_3_BINS, d3)
    if d1 is None:
        return None
    if d1 < 0:
        return "uv"
    if d2 is None or d2 < 0:
        return label(1, C.DOSE_1_BINS, d1)
    return label(2, C.DOSE_2_BINS, d2)


def test_every_day_falls_in_one_bin(spark):
    cases = [(d, None, None) for d in range(-2, 40)]
    cases += [(d + 30, d, None) for d in range(-40, 260)]
    cases += [(d + 200, d + 150, d) for d in range(-210, 60)]
    cases += [(None, None, None)]
    rows = [
        (i, day(400), *[None if d is None else day(400 - d) for d in case])
        for i, case in enumerate(cases)
    ]
    df = spark.createDataFrame(
        rows,
        "i int, dt_inicio_sintomas date, d1_data_aplicacao date, d2_data_aplicacao date, d3_data_aplicacao date",
    )
    got = df.transform(E.days_since_dose).transform(E.vacc_status).orderBy("i").collect()
    assert [r["vacc_status"] for r in got] == [status_by_rule(*case) for case in cases]


def labels_of(spark, rows):
    df = spark.createDataFrame(
        rows, "i int, d1_nome_vacina string, d3_nome_vacina string, vacc_status string"
    )
    return {r["i"]: r for r in df.transform(E.vs_type).collect()}


def test_labels(spark):
    got = labels_of(
        spark,
        [
            (1, "uv", None, None),
            (2, "CV", None, "uv"),
            (3, None, None, "uv"),
            (4, "CV", "BNT162b2", "v3_31+"),
            (5, "AZ", None, "v3_0:6"),
            (6, "Ad26", None, "v2_0:13"),
            (7, "Ad26", "Ad26", "v3_0:6"),
            (8, "CV", None, "v2_181+"),
        ],
    )
    assert {i: r["vs_type"] for i, r in got.items()} == {
        1: "uv", 2: "uv", 3: "NA_uv", 4: "CV_v3_31+", 5: "AZ_v3_0:6", 7: "Ad26_v3_0:6", 8: "CV_v2_181+",
    }
    assert got[4]["vs_type2"] == "CV_v3_31+_BNT162b2"
    assert got[5]["vs_type2"] == "AZ_v3_0:6_NA"
    assert got[4]["vacc_3_type"] == "CV-BNT162b2"
    assert got[8]["vacc_3_type"] is None


@pytest.mark.parametrize(
    "record, flag",
    [
        ({"d1_data_aplicacao": 0, "d2_data_aplicacao": 12}, 1),
        ({"d1_data_aplicacao": 0, "d2_data_aplicacao": 13}, 0),
        ({"d1_data_aplicacao": -334}, 0),
        ({"d1_data_aplicacao": -335}, 1),
        ({"d1_data_aplicacao": 0, "d2_nome_vacina": C.PFIZER}, 1),
        ({"d1_data_aplicacao": 0, "d1_nome_vacina": None, "d2_nome_vacina": C.PFIZER}, 0),
    ],
)
def test_consistency(vacc, record, flag):
    row = {"d1_nome_vacina": C.CORONAVAC, **record}
    assert vacc([row]).select(E.inconsistency_flag(CFG).alias("f")).first()["f"] == flag


def test_brand_merge_precedes_the_product_check(vacc):
    row = {
        "d1_data_aplicacao": 0, "d2_data_aplicacao": 60,
        "d1_nome_vacina": C.COVISHIELD, "d2_nome_vacina": C.ASTRAZENECA,
    }
    got = vacc([row]).transform(E.coded_vaccination, CFG).first()
    assert (got["flag_incon"], got["d1_nome_vacina"], got["d2_nome_vacina"]) == (0, "AZ", "AZ")


def test_join_keeps_every_test_once(lab, vacc):
    tests = lab(person_tests(1, (0, "N"), (40, "C")) + person_tests(2, (0, "N"))).transform(P.clean_tests, CFG)
    coded = vacc([{"d1_data_aplicacao": 10, "d1_nome_vacina": C.PFIZER}]).transform(
        E.coded_vaccination, CFG
    )
    rows = tests.transform(E.join_vaccination, coded).orderBy("rec_id").collect()
    assert [r["d1_nome_vacina"] for r in rows] == ["BNT162b2", "BNT162b2", "uv"]
    assert [r["flag_incon"] for r in rows] == [0, 0, 0]


def test_null_status_option(lab, vacc):
    from dataclasses import replace

    tests = lab(person_tests(1, (300, "N")))
    nobody = vacc([{"id_vigvac": 9, "d1_data_aplicacao": 10, "d1_nome_vacina": C.PFIZER}])
    default = P.analysis_table(tests, nobody, CFG).first()
    asked = P.analysis_table(tests, nobody, replace(CFG, null_status_unvaccinated=True)).first()
    assert default["vacc_status"] is None and default["vs_type"] == "uv"
    assert (default["psm_vacc"], asked["psm_vacc"]) == ("Vacc", "UVacc")
