"""Persons, classification, reshaping, tables, series and readers on small frames."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

import pytest
from study_rows import DAY0, day, person_tests

from caselink import config as C
from caselink.functions import age_band, clean_name, clean_names, month_start, paste, week_centre
from caselink.operators import classify, persons, regions, reshape, series, tables
from caselink.operators.levels import lump_levels
from caselink.sources import CARRIER_STUDY as CFG
from caselink.sources import read_lookup, read_parquet, read_tagged, read_wide_table
from pyspark.sql import functions as F


# --- scalar helpers ---------------------------------------------------------------------------


def test_paste_shows_null(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) AS a, 'x' AS b").select(paste("a", "b").alias("p"))
    assert row.first()["p"] == "NA_x"


@pytest.mark.parametrize("value, centre", [(-4, -7), (-3, 0), (3, 0), (4, 7), (10, 7), (11, 14)])
def test_week_centre(spark, value, centre):
    assert spark.range(1).select(week_centre(F.lit(value)).alias("c")).first()["c"] == centre


def test_age_bands(spark):
    df = spark.createDataFrame([(17,), (18,), (59,), (60,), (79,), (80,), (None,)], "a int")
    got = [r["b"] for r in df.select(age_band("a", C.MODEL_BANDS).alias("b")).collect()]
    assert got == [None, "18-59", "18-59", "60-79", "60-79", "80+", None]
    got = [r["b"] for r in df.select(age_band("a", C.UPTAKE_BANDS).alias("b")).collect()]
    assert got == ["12-17", "18-59", "18-59", "60-79", "60-79", "80+", None]


def test_month_start(spark):
    df = spark.createDataFrame([("Fev 2021",), ("Dez 2020",), ("Foo 2021",)], "p string")
    got = [r["m"] for r in df.select(month_start("p", C.MONTHS).alias("m")).collect()]
    assert got == [date(2021, 2, 1), date(2020, 12, 1), None]


def test_month_sequence(spark):
    axis = series.month_sequence(date(2020, 2, 1), date(2020, 9, 1), 3)
    got = spark.range(1).select(axis.alias("d")).first()["d"]
    assert got == [date(2020, 2, 1), date(2020, 5, 1), date(2020, 8, 1)]


def test_clean_names(spark):
    assert clean_name("Período") == "periodo"
    assert clean_name(" Quantidade (n)") == "quantidade_n"
    assert clean_name("2020 total %") == "x2020_total_percent"
    df = spark.createDataFrame([(1, 2)], ["A b", "a.B"])
    assert clean_names(df).columns == ["a_b", "a_b_2"]


# --- reshaping --------------------------------------------------------------------------------


def test_wide_to_long(spark):
    wide = spark.createDataFrame(
        [(1, "a", 10, "b", None), (2, None, 11, None, 12), (3, "c", None, "d", None)],
        "id int, n1_when string, n1_x int, n2_when string, n2_y int",
    )
    rows = reshape.wide_to_long(wide, ["id"], "when").orderBy("id", "level").collect()
    assert [tuple(r) for r in rows] == [
        (1, "1", "a", 10, None), (1, "2", "b", None, None), (3, "1", "c", None, None), (3, "2", "d", None, None),
    ]


def test_unions(spark):
    a, b = spark.sql("SELECT 1 AS x"), spark.sql("SELECT 2 AS y")
    rows = reshape.tagged_union({"a": a, "b": b}, "id").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("a", 1, None), ("b", None, 2)]


def test_without_rejects_unknown_names(spark):
    with pytest.raises(ValueError, match="nope"):
        reshape.without(spark.range(1), "nope")


def test_row_sum_is_null_if_any_is(spark):
    df = spark.createDataFrame([(1, 1), (1, None)], "a int, b int")
    assert [r["s"] for r in df.select(reshape.row_sum(["a", "b"]).alias("s")).collect()] == [2, None]


# --- persons ----------------------------------------------------------------------------------


def test_keep_first_groups_null_keys(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), (1, 5)], "k int, v int")
    rows = persons.keep_first(df, ["k"], ["v"]).collect()
    assert sorted((r["k"] is None, r["v"]) for r in rows) == [(False, 5), (True, 1)]


def test_first_positive_keeps_persons_never_positive(lab):
    tests = person_tests(1, (5, "C"), (3, "C"), (1, "N")) + person_tests(2, (0, "N"))
    rows = lab(tests).transform(persons.attach_first_positive).orderBy("rec_id").collect()
    assert [r["firstcasedate"] for r in rows] == [day(3)] * 3 + [None]


def test_comorbidities_ignore_unknown_records(spark):
    rows = [(1, 0), (1, None), (2, None), (3, 1), (3, 0)]
    df = spark.createDataFrame(rows, "id_vigvac int, diabetes int")
    got = persons.person_comorbidities(df, ["diabetes"]).collect()
    assert {r["id_vigvac"]: r["diabetes"] for r in got} == {1: 0, 2: None, 3: 1}


# --- classification ---------------------------------------------------------------------------

SG = "rec_id int, sg_tipoteste_2 string, sg_resultadoteste string, sg_dt_datateste date, sg_dt_datainiciosintomas date"


def test_outpatient_classes(spark):
    rows = [
        (1, "RT-PCR", "Detectável", None, None),
        (2, "Sorologia", "Positivo", None, None),
        (3, "Antígeno", "Negativo", day(10), day(0)),
        (4, "Antígeno", "Negativo", day(11), day(0)),
        (5, "Antígeno", "Negativo", day(11), None),
        (6, "RT-PCR", None, day(1), day(0)),
    ]
    got = spark.createDataFrame(rows, SG).transform(classify.classify_outpatient, CFG).collect()
    assert {r["rec_id"]: r["sg_confirmado"] for r in got} == {1: C.CASE, 3: C.CONTROL}


SRAG = (
    "rec_id int, srag_pcr_sars2 string, srag_an_sars2 string, srag_pcr_resul string, srag_res_an string, "
    "srag_dt_coleta date, srag_dt_pcr date, srag_dt_res_an date, srag_dt_sin_pri date"
)


def test_hospital_classes(spark):
    rows = [
        (1, None, "1", "4", None, None, None, day(3), day(0)),  # antigen case, dated by its result
        (2, None, None, "2", None, None, day(10), day(3), day(0)),
        (3, None, None, "2", None, day(11), day(10), None, day(0)),  # too late
        (4, None, None, "4", "2", day(1), None, None, day(0)),  # negative by antigen result only
        (5, None, None, "9", None, None, day(1), None, day(0)),
    ]
    df = spark.createDataFrame(rows, SRAG)
    got = {r["rec_id"]: r for r in df.transform(classify.classify_hospital, CFG).collect()}
    assert {i: r["srag_confirmado"] for i, r in got.items()} == {1: C.CASE, 2: C.CONTROL}
    assert got[1]["tipo_teste"] == C.ANTIGEN and got[1]["srag_dt_coleta"] == day(3)
    assert got[2]["srag_dt_coleta"] == day(10)
    wider = df.transform(classify.classify_hospital, replace(CFG, use_antigen_result=True))
    assert {r["rec_id"] for r in wider.collect()} == {1, 2, 4}


# --- levels and tables ------------------------------------------------------------------------


def levels(spark, counts: dict[str, int], keep: int) -> dict[str, str]:
    df = spark.createDataFrame([(k, n) for k, n in counts.items()], "k string, w int")
    lumped = lump_levels(df.withColumn("was", F.col("k")), "k", keep, weight="w").collect()
    return {r["was"]: r["k"] for r in lumped}


def test_lumping(spark):
    assert levels(spark, {"a": 9, "b": 5, "c": 2, "d": 1}, 2) == {"a": "a", "b": "b", "c": "Other", "d": "Other"}
    assert levels(spark, {"a": 9, "b": 5, "c": 2}, 2) == {"a": "a", "b": "b", "c": "c"}
    assert levels(spark, {"a": 9, "b": 5, "c": 5, "d": 1, "e": 1}, 2) == {
        "a": "a", "b": "b", "c": "c", "d": "Other", "e": "Other",
    }


def test_lumping_joins_the_kept_levels(spark):
    assert levels(spark, {"a": 9, "b": 5, "c": 2, "d": 1}, 2) == {"a": "a", "b": "b", "c": "Other", "d": "Other"}


def exposures(spark, cells):
    rows = [
        (label, outcome, 40, "RT-PCR", "x", "x", "x")
        for label, outcome, n in cells
        for _ in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "vs_type2 string, confirmado string, idade int, tipo_teste string, outcome_confirmado string, hosp_event string, death_event string",
    )


CELLS = [
    ("uv", C.CASE, 6), ("uv", C.CONTROL, 3), ("CV_v2_0:13", C.CASE, 2), ("CV_v2_0:13", C.CONTROL, 5),
    ("CV_v1_0:6", C.CONTROL, 2), ("CV_v3_31+_CV", C.CASE, 4), ("AZ_v1_0:6", C.CASE, 1),
]


def test_exposure_table_has_zero_cells(spark):
    got = exposures(spark, CELLS).transform(tables.exposure_by_outcome, cohorts=["Infection"]).collect()
    cells = {(r["vs_type2"], r["stratum"]): r for r in got}
    assert len(got) == 9  # three reported labels, three strata
    assert cells["CV_v1_0:6", C.CASE]["n"] == 0
    assert cells["CV_v1_0:6", C.CONTROL]["row_pct"] == 100
    assert cells["uv", "Overall"]["col_pct"] == 50
    assert cells["uv", C.CASE]["col_pct"] == 75


def test_crude_odds_ratio(spark):
    got = exposures(spark, CELLS).transform(tables.crude_or, cohorts=["Infection"]).collect()
    rows = {r["vs_type2"]: r for r in got}
    assert rows["CV_v2_0:13"]["odds_ratio"] == pytest.approx(2 * 3 / (5 * 6))
    assert rows["CV_v2_0:13"]["std_error"] == pytest.approx((1 / 2 + 1 / 5 + 1 / 6 + 1 / 3) ** 0.5)
    assert rows["CV_v1_0:6"]["odds_ratio"] is None
    assert rows["AZ_v1_0:6"]["odds_ratio"] is None


def test_baseline_table(spark):
    rows = [(C.CASE, "F", 1, 30), (C.CASE, None, 0, 40), (C.CONTROL, "M", None, 50), (C.CONTROL, "M", 1, 60)]
    df = spark.createDataFrame(rows, "confirmado string, sexo string, flag int, idade int")
    got = df.transform(tables.baseline_table, categories=["sexo"], flags=["flag"], numbers=["idade"])
    cells = {(r["variable"], r["level"], r["stratum"]): r for r in got.collect()}
    assert cells["sexo", "F", C.CASE]["stat"] == 100 and cells["sexo", "F", C.CASE]["n_known"] == 1
    assert cells["sexo", "F", C.CONTROL]["n"] == 0
    assert cells["sexo", "Unknown", C.CASE]["n"] == 1 and cells["sexo", "Unknown", C.CASE]["stat"] is None
    assert ("flag", "0", C.CASE) not in cells
    assert cells["flag", "1", "Overall"]["n"] == 2 and cells["flag", "1", "Overall"]["n_known"] == 3
    assert cells["idade", "p50", "Overall"]["stat"] == 45
    assert cells["idade", "p25", C.CASE]["stat"] == 32.5


# --- series -----------------------------------------------------------------------------------


def test_complete_days(spark):
    rows = [("a", day(0), 1.0), ("a", day(3), 2.0), ("b", day(6), 5.0), (None, day(4), 1.0)]
    df = spark.createDataFrame(rows, "g string, d date, v double")
    got = series.complete_days(df, ["g"], "d", day(5), carry=["v"]).collect()
    a = sorted(((r["d"] - DAY0).days, r["v"]) for r in got if r["g"] == "a")
    assert a == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 2.0), (4, 2.0), (5, 2.0)]
    assert [(r["d"], r["v"]) for r in got if r["g"] == "b"] == [(day(6), 5.0)]
    assert sorted(((r["d"] - DAY0).days, r["v"]) for r in got if r["g"] is None) == [(4, 1.0), (5, 1.0)]


def test_uptake_curves_never_fall(vacc):
    rows = [
        {"id_vigvac": i, "d_idade": 10 + i, "d1_data_aplicacao": i % 9, "d2_data_aplicacao": 40 + i % 5,
         "d1_nome_vacina": C.CORONAVAC if i % 2 else C.PFIZER, "d2_nome_vacina": C.CORONAVAC if i % 2 else C.PFIZER}
        for i in range(1, 80)
    ]
    got = vacc(rows).transform(series.uptake_cumulative, CFG).collect()
    curves: dict = {}
    for r in got:
        curves.setdefault((r["course"], r["dose"], r["faixa_etaria"]), []).append((r["data"], r["cumulative"], r["n"]))
    for points in curves.values():
        points.sort()
        assert all(b[1] - a[1] == b[2] > 0 for a, b in zip(points, points[1:]))
    consistent = sum(1 for r in rows if r["d_idade"] >= 12)
    first = [p[-1][1] for (course, dose, _), p in curves.items() if (course, dose) == ("all", "d1_data_aplicacao")]
    assert sum(first) == consistent


def test_severe_outcomes_admitted_only(lab):
    tests = [
        {"id_vigvac": 1, "confirmado": C.CASE, "evolucao": "2", "dt_evoluca": 5},
        {"id_vigvac": 2, "confirmado": C.CASE, "dt_interna_dt": 3},
    ]
    frame = lab(tests)
    every = series.severe_outcomes(frame, CFG).collect()
    narrow = series.severe_outcomes(frame, CFG, admitted_only=True).collect()
    assert sorted(r["data_severe"] for r in every) == [day(3), day(5)]
    assert sorted(r["data_severe"] for r in narrow) == [day(3), day(5)]
    assert len(series.severe_outcomes(frame.where("id_vigvac = 1"), CFG, True).collect()) == 1



def test_deaths_without_a_person_id_stay_severe(lab):
    """No id matches no admission, so such a death counts beside the record itself; ties and repeated
    rows of one person, admission date and result count once."""
    death = {"confirmado": C.CASE, "evolucao": "2", "dt_evoluca": 5}
    frame = lab([{"id_vigvac": None, **death}, {"id_vigvac": 4, **death}, {"id_vigvac": 4, **death}])
    for only, expected in ((False, [(None, 1), (None, 1), (4, 2)]), (True, [(None, 1), (4, 2)])):
        rows = series.severe_outcomes(frame, CFG, only).collect()
        assert sorted(((r["id_vigvac"], r["rec_id"]) for r in rows), key=lambda r: (r[0] or 0, r[1])) == expected
    assert series.epidemic_series(frame.where("false"), CFG).count() == 0


# --- regions and readers ----------------------------------------------------------------------


@pytest.mark.parametrize("limit", [100, 0])
def test_region_lookup(spark, limit):
    lookup = spark.createDataFrame([("3500011", "350002"), ("2900022", "290001")], "CD_GEOCODI string, cod_rgi string")
    df = spark.createDataFrame([(1, "350001"), (2, "530010"), (3, None)], "i int, cod_ibge string")
    got = regions.region_lookup_join(df, lookup, CFG, broadcast_rows=limit).orderBy("i").collect()
    assert [r["cod_rgi"] for r in got] == ["350002", "530001", "530001"]


def test_region_lookup_must_be_unique(spark):
    lookup = spark.createDataFrame([("3500011", "1"), ("3500012", "2")], "CD_GEOCODI string, cod_rgi string")
    with pytest.raises(ValueError, match="more than one row"):
        regions.region_lookup_join(spark.createDataFrame([("350001",)], "cod_ibge string"), lookup, CFG)


def test_readers(spark, tmp_path):
    for name, value in (("Overall", 1), ("60-79", 2)):
        spark.createDataFrame([(value,)], "x int").write.parquet(f"{tmp_path}/sheets/{name}.parquet")
    tagged = read_tagged(spark, f"{tmp_path}/sheets").orderBy("x").collect()
    assert [tuple(r) for r in tagged] == [("Overall", 1), ("60-79", 2)]

    (tmp_path / "codes.csv").write_text("code,name\n0123,a\n")
    assert read_lookup(spark, f"{tmp_path}/codes.csv", "code string, name string").first()["code"] == "0123"
    (tmp_path / "voc.csv").write_text("Período;Nº Casos\nJan 2021;3\n")
    assert read_wide_table(spark, f"{tmp_path}/voc.csv", sep=";").columns == ["periodo", "no_casos"]

    spark.range(3).write.parquet(f"{tmp_path}/parts")
    assert read_parquet(spark, f"{tmp_path}/parts", ["id"], part_glob="part-*.parquet").count() == 3


def test_exact_quantiles_equal_sql(spark):
    import duckdb
    import numpy as np
    import pandas as pd

    from caselink.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(4)
    rows = [("all different", float(x)) for x in rng.normal(size=3000)]
    rows += [("geometric", float(10.0 ** k)) for k in range(-150, 150)]
    rows += [("mostly one", 5.0)] * 2000 + [("mostly one", float(x)) for x in rng.uniform(0, 10, 400)]
    rows += [("ages", float(x)) for x in rng.integers(18, 90, 2500)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), (None, 7.0), (None, 9.5), ("unknown", None)]
    got = exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", [0.25, 0.5, 0.75, 1.0, 0.333])
    frame = pd.DataFrame(rows, columns=["g", "v"])
    want = duckdb.sql("SELECT g, count(v) AS n, quantile_cont(v, [0.25, 0.5, 0.75, 1.0, 0.333]) AS q FROM frame WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY g").fetchall()
    assert {(r["g"], r["n"]) for r in got.collect()} == {(g, n) for g, n, _ in want}
    table = {g: q for g, _, q in want}
    for r in got.collect():
        assert r["quantiles"] == pytest.approx(table[r["g"]], rel=1e-9)
    assert exact_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", [0.5]).collect() == []
