"""Plans, skew and the ledger."""

from __future__ import annotations

import os
import re

import duckdb
import pytest
from study_rows import crowd, day, exchanges, plan

from caselink import config as C
from caselink.operators import persons, records, series
from caselink.oracle import _sql
from caselink.plans import cohort as P
from caselink.plans.ledger import STEPS, attrition
from caselink.queries import QUERIES
from caselink.sources import CARRIER_STUDY as CFG

SF = "/root/testdata/sf0.001"


def in_duckdb(lab_rows, vacc_rows, sql: str) -> list[tuple]:
    connection = duckdb.connect()
    connection.register("lab_rows", lab_rows.toArrow())
    connection.register("vacc_rows", vacc_rows.toArrow())
    connection.execute("CREATE VIEW lab AS SELECT * FROM lab_rows")
    connection.execute("CREATE VIEW vacc AS SELECT * FROM vacc_rows")
    return connection.execute(sql).fetchall()


def test_hot_person_gives_the_same_rows(lab, vacc):
    tests, doses = crowd(lab, vacc)
    columns = ["rec_id", "seq_no", "days_diff_test", "outcome", "vs_type2", "firstcasedate"]
    sql = _sql(f"SELECT {', '.join(columns)} FROM analysis ORDER BY rec_id", given=("lab", "vacc"))
    expected = in_duckdb(tests, doses, sql)
    got = P.analysis_table(tests, doses, CFG).select(*columns).orderBy("rec_id").collect()
    assert [tuple(r) for r in got] == expected
    assert len(got) > 50


def test_ledger_adds_up_and_agrees_with_the_filters(lab, vacc):
    tests, doses = crowd(lab, vacc)
    rows = attrition(tests, doses, CFG).orderBy("step_no").collect()
    assert [r["step"] for r in rows] == STEPS
    remaining = tests.count()
    for row in rows:
        assert row["removed"] >= 0
        assert remaining - row["removed"] == row["remaining"]
        remaining = row["remaining"]
    assert remaining == P.analysis_table(tests, doses, CFG).count()
    by_step = {r["step"]: r["remaining"] for r in rows}
    assert by_step["false_negative"] == P.without_false_negatives(tests, CFG).count()
    assert by_step["mixed_spacing"] == P.spaced_tests(tests, CFG).count()
    assert by_step["severe_negative"] == P.clean_tests(tests, CFG).count()


def test_first_record_selection_limits_rows_before_the_shuffle(lab):
    text = plan(lab([{}]).transform(persons.dedup_tests))
    before, after = text.split("Exchange", 1)[1], text.split("Exchange", 1)[0]
    assert "WindowGroupLimit" in before and "Partial" in before
    assert "Final" in after


def test_rules_share_one_partitioning(spark, lab, vacc):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tests, doses = lab([{}]), vacc([{"d1_data_aplicacao": 0}])
        text = plan(P.analysis_table(tests, doses, CFG))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [e.split("#")[0] for e in exchanges(text)] == ["hashpartitioning(id_vigvac"] * 3
    assert text.count("SortMergeJoin") == 1


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["scan_registry"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in text
    assert "o_totalprice" not in text


@pytest.mark.parametrize(
    "name",
    [
        "analysis_table", "attrition", "exposure_by_outcome", "crude_or", "baseline_table_strata",
        "person_features", "harmonise_notifications", "epidemic_series", "severe_outcomes",
        "uptake_cumulative", "uptake_filled", "booster_mix", "variant_share", "unique_persons",
    ],
)
def test_plans_stay_in_the_jvm_and_never_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text, bad


def test_no_window_gathers_a_whole_table(spark):
    """A window without a partition would put every row into one task."""
    for name in ("analysis_table", "attrition", "exposure_by_outcome", "uptake_filled", "variant_share"):
        text = plan(QUERIES[name](spark, SF))
        for line in text.splitlines():
            if re.search(r"\bWindow \[", line):
                assert re.search(r"\], \[[^\]]+\](, \[|$)", line), (name, line[:200])


def test_uptake_counts_before_it_accumulates(vacc):
    text = plan(vacc([{"d1_data_aplicacao": 0}]).transform(series.uptake_cumulative, CFG))
    assert "partial_count" in text


def test_notified_tests_drop_late_onsets(lab):
    rows = lab([{"dt_inicio_sintomas": 14}, {"dt_inicio_sintomas": 15}]).transform(
        series.notified_tests, CFG
    )
    assert [r["rec_id"] for r in rows.collect()] == [1]


def test_imputed_dates(lab):
    rows = (
        lab(
            [
                {"dt_coleta": None, "dt_notificacao": 4, "confirmado": C.CASE, "dt_inicio_sintomas": None},
                {"dt_coleta": None, "dt_notificacao": 4, "dt_inicio_sintomas": None},
            ]
        )
        .transform(records.impute_dates)
        .orderBy("rec_id")
        .collect()
    )
    assert [(r["dt_coleta"], r["dt_inicio_sintomas"]) for r in rows] == [(day(4), day(4)), (None, None)]


def _split_joins(df) -> int:
    """Skewed joins in the plan that ran."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("skew=true")


@pytest.mark.parametrize("step", [persons.attach_first_positive, persons.person_features])
def test_a_hot_person_is_split_over_join_tasks(spark, lab, tmp_path, step):
    records = [
        {"id_vigvac": 1 if i % 3 else i, "dt_coleta": i % 300, "confirmado": C.CASE if i % 5 else C.CONTROL}
        for i in range(3000)
    ]
    lab(records).repartition(8).write.parquet(str(tmp_path / "lab"))
    tests = spark.read.parquet(str(tmp_path / "lab"))
    lowered = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in lowered.items():
        spark.conf.set(key, value)
    try:
        joined = tests.transform(step)
        assert _split_joins(joined) > 0
        assert joined.count() == len(records)
    finally:
        for key in lowered:
            spark.conf.unset(key)


def test_epidemic_series_reads_and_moves_the_notifications_once(spark, lab, tmp_path):
    lab([{"rec_id": i, "dt_interna_dt": i % 5} for i in range(50)]).write.parquet(str(tmp_path / "lab"))
    tests = spark.read.parquet(str(tmp_path / "lab"))
    text = plan(series.epidemic_series(tests, CFG))
    assert text.count("FileScan") == 1 and "Join" not in text
    moved = [e.split("#")[0] for e in exchanges(text)]
    assert len(moved) == 2 and moved[1] == "hashpartitioning(id_vigvac"  # the other one: by series and week
    before = text.split("Exchange hashpartitioning(id_vigvac", 1)[1]
    assert "partial_min_by" in before  # a hot person leaves one row per task and group
    severe = plan(series.severe_outcomes(tests, CFG))
    assert severe.count("FileScan") == 1 and len(exchanges(severe)) == 1


def test_savepoints_need_a_shared_folder(spark, monkeypatch):
    from caselink import session

    class Context:
        master = "local[2]"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_savepoints_are_released(spark):
    from caselink import session

    kept = session.savepoint(spark.range(3), "three")
    assert kept.count() == 3
    path = kept.inputFiles()[0].removeprefix("file://")
    folder = path.split("/savepoints/")[0] + "/savepoints/" + spark.sparkContext.applicationId
    assert os.path.isdir(folder) and path.startswith(folder)
