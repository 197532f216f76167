"""Boundaries of the order-dependent rules."""

from __future__ import annotations

import pytest
from study_rows import DAY0, person_tests

from caselink.operators import window_rules as W
from caselink.operators.records import outcome_events
from caselink.plans import cohort as P
from caselink.sources import CARRIER_STUDY as CFG


def left(df) -> list[tuple[int, str]]:
    rows = df.select("id_vigvac", "dt_coleta", "confirmado", "rec_id").collect()
    return sorted((r["id_vigvac"], (r["dt_coleta"] - DAY0).days, r["confirmado"][0]) for r in rows)


@pytest.mark.parametrize(
    "tests, kept",
    [
        ([(0, "N"), (7, "C")], [7]),
        ([(0, "N"), (8, "C")], [0, 8]),
        ([(0, "N"), (3, "N"), (6, "C")], [0, 6]),  # only the immediately next test counts
        ([(0, "C"), (3, "N")], [0, 3]),
        ([(5, "N"), (5, "C")], [5, 5]),  # same day: the positive sorts first
    ],
)
def test_false_negatives(lab, tests, kept):
    result = lab(person_tests(1, *tests)).transform(P.without_false_negatives, CFG)
    assert [d for _, d, _ in left(result)] == kept


@pytest.mark.parametrize(
    "tests, kept",
    [
        ([(0, "N"), (14, "N")], [0]),
        ([(0, "N"), (15, "N")], [0, 15]),
        ([(0, "N"), (14, "N"), (28, "N")], [0]),  # gaps are not recomputed after a removal
        ([(0, "C"), (90, "C")], [0]),
        ([(0, "C"), (91, "C")], [0, 91]),
        ([(0, "N"), (10, "N"), (60, "C")], [0, 10, 60]),  # mixed persons are left alone here
    ],
)
def test_same_result_spacing(lab, tests, kept):
    result = lab(person_tests(1, *tests)).transform(P.spaced_same_result, CFG)
    assert [d for _, d, _ in left(result)] == kept


@pytest.mark.parametrize(
    "tests, kept",
    [
        ([(0, "C"), (30, "C"), (200, "N")], [0, 200]),
        ([(0, "C"), (91, "C"), (200, "N")], [0, 91, 200]),
        ([(0, "C"), (40, "N"), (90, "C")], [0, 40]),  # two steps back
        ([(0, "C"), (40, "N"), (91, "C")], [0, 40, 91]),
        ([(0, "N"), (8, "C"), (200, "N")], [0, 8, 200]),
    ],
)
def test_mixed_result_spacing(lab, tests, kept):
    result = lab(person_tests(1, *tests)).transform(P.spaced_tests, CFG)
    assert [d for _, d, _ in left(result)] == kept


@pytest.mark.parametrize("gap, kept", [(28, [0]), (29, [0, 29])])
def test_severe_negative_after_positive(lab, gap, kept):
    tests = person_tests(1, (0, "C")) + person_tests(1, (gap, "N"), dt_interna_dt=gap)
    result = lab(tests).transform(P.clean_tests, CFG)
    assert [d for _, d, _ in left(result)] == kept


@pytest.mark.parametrize("gap, kept", [(28, [28]), (29, [0, 29])])
def test_severe_negative_before_positive(lab, gap, kept):
    tests = person_tests(1, (0, "N"), dt_interna_dt=0) + person_tests(1, (gap, "C"))
    result = lab(tests).transform(P.clean_tests, CFG)
    assert [d for _, d, _ in left(result)] == kept


def test_rules_do_not_cross_persons(lab):
    tests = person_tests(1, (0, "N")) + person_tests(2, (3, "C"))
    assert len(left(lab(tests).transform(P.clean_tests, CFG))) == 2


def test_first_positive_counts_tests_below_the_onset_floor(lab):
    early = (CFG.onset_floor - DAY0).days - 30
    tests = person_tests(1, (early, "C"), (200, "N"))
    rows = lab(tests).transform(P.distinct_tests, CFG).collect()
    assert len(rows) == 1
    assert (rows[0]["firstcasedate"] - DAY0).days == early


def test_duplicates_keep_the_first_record_above_the_floor(lab):
    floor = (CFG.onset_floor - DAY0).days
    tests = [
        {"dt_coleta": 10, "dt_inicio_sintomas": floor},
        {"dt_coleta": 10, "dt_inicio_sintomas": 9},
        {"dt_coleta": 10, "dt_inicio_sintomas": 10},
    ]
    rows = lab(tests).transform(P.distinct_tests, CFG).collect()
    assert [r["rec_id"] for r in rows] == [2]


def test_fill_down_reaches_rows_without_admission(lab):
    tests = [
        {"dt_coleta": 0},
        {"dt_coleta": 50, "dt_interna_dt": 52, "evolucao": "2", "dt_evoluca": 60},
        {"dt_coleta": 20, "dt_interna_dt": 22},
    ]
    rows = lab(tests).transform(W.fill_down).orderBy("rec_id").collect()
    assert [(r["dt_interna_dt"] - DAY0).days for r in rows] == [52, 52, 22]
    assert [r["evolucao"] for r in rows] == ["2", "2", None]


@pytest.mark.parametrize(
    "admitted, died, hospital, death, wide",
    [
        (28, None, True, False, False),
        (-28, None, True, False, False),
        (29, None, False, False, False),
        (None, 0, False, True, True),
        (None, 28, False, True, True),
        (None, 29, False, False, True),
        (None, 91, False, False, False),
        (None, -1, False, False, False),
    ],
)
def test_outcome_windows(lab, admitted, died, hospital, death, wide):
    test = {"dt_interna_dt": admitted, "dt_evoluca": died, "evolucao": "3" if died is not None else "1"}
    row = lab([test]).transform(outcome_events, CFG).first()
    assert (row["hosp_event"] == "Hospitalization") is hospital
    assert (row["death_event"] == "Death-related") is death
    assert (row["death_event_sensi"] == "Death-related") is wide
    assert (row["outcome"] == "Hosp_Death") is (hospital or death)


def test_result_does_not_depend_on_input_order_or_partitions(spark, lab):
    tests = []
    for person in range(1, 40):
        days = [(person * k * 7) % 300 for k in range(1, 12)]
        tests += person_tests(person, *[(d, "C" if (d + person) % 3 == 0 else "N") for d in days])
    frame = lab(tests)
    expected = left(frame.transform(P.clean_tests, CFG))
    shuffled = frame.orderBy(frame.rec_id.desc()).repartition(7)
    assert left(shuffled.transform(P.clean_tests, CFG)) == expected
