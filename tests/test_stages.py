"""Shared stages: found again, never read half-written, deleted by the last owner."""

from __future__ import annotations

import os
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from caselink import session
from caselink.plans import cohort as P
from caselink.session import bucketed_stage, content_key, release, savepoint, shared_stage
from caselink.sources import CARRIER_STUDY as CFG
from study_rows import crowd, exchanges, plan


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(100).withColumn("x", F.col("id") % 7).write.parquet(path)
    return path


def homes(root):
    folder = f"{root}/stages"
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def attempts(root, home):
    return [f for f in os.listdir(f"{root}/stages/{home}") if f.startswith("attempt-")]


def test_equal_plans_on_equal_files_share_one_write(spark, table, tmp_path):
    root = str(tmp_path / "shared")

    def build(modulus=7):
        return spark.read.parquet(table).where(F.col("x") % modulus > 2).groupBy("x").count()

    first, second = (shared_stage(build(), "counts", root) for _ in range(2))
    assert sorted(first.collect()) == sorted(second.collect()) == sorted(build().collect())
    assert len(homes(root)) == 1 and len(attempts(root, homes(root)[0])) == 1
    shared_stage(build(5), "counts", root)
    assert len(homes(root)) == 2
    spark.range(5).withColumn("x", F.lit(6).cast("bigint")).write.mode("append").parquet(table)
    assert shared_stage(build(), "counts", root).where("x = 6").first()["count"] == build().where("x = 6").first()["count"]
    assert len(homes(root)) == 3


def test_a_write_without_a_marker_is_never_read(spark, table, tmp_path):
    root = str(tmp_path / "shared")
    df = spark.read.parquet(table).select("x")
    home = f"{root}/stages/part-{content_key(df)}"
    spark.read.parquet(table).select("x").limit(3).write.parquet(f"{home}/attempt-broken")
    assert shared_stage(df, "part", root).count() == 100
    assert shared_stage(df, "part", root).count() == 100
    assert len(attempts(root, os.path.basename(home))) == 2


def test_the_last_owner_deletes_the_stage(spark, table, tmp_path):
    root = str(tmp_path / "shared")
    kept = shared_stage(spark.read.parquet(table).select("x"), "owned", root)
    home = homes(root)[0]
    other = f"{root}/stages/{home}/owners/another-application"
    open(other, "w").close()
    session._release_stages(spark, root)
    assert homes(root) == [home] and kept.count() == 100
    os.remove(other)
    assert shared_stage(spark.read.parquet(table).select("x"), "owned", root).count() == 100
    assert len(attempts(root, home)) == 1
    session._release_stages(spark, root)
    assert homes(root) == []


def test_what_is_not_all_in_files_is_not_shared(spark, table):
    rows = spark.read.parquet(table)
    assert content_key(spark.createDataFrame([(1,)], "x int")) is None
    assert content_key(rows.withColumn("r", F.rand())) is None
    assert content_key(rows.join(spark.createDataFrame([(1,)], "x int"), "x")) is None
    assert content_key(rows) != content_key(rows.select("x"))
    wide = rows.select(*[(F.col("x") + i).alias(f"c{i}") for i in range(60)])
    other = rows.select(*[(F.col("x") + (i if i != 55 else 99)).alias(f"c{i}") for i in range(60)])
    assert content_key(wide) != content_key(other)


def test_queries_prepare_the_cohort_once(spark):
    from caselink import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the test tables")
    root = session.shared_dir(spark)
    release(spark)
    queries.QUERIES["prepare_cohort"](spark, folder).count()
    once = {h: attempts(root, h) for h in homes(root)}
    assert any(h.startswith("linked-") for h in once)
    queries.QUERIES["ve_single_factor"](spark, folder).count()
    queries.QUERIES["ve_single_factor_age"](spark, folder).count()
    again = {h: attempts(root, h) for h in homes(root)}
    assert all(len(a) == 1 for a in again.values()) and again.items() >= once.items()
    assert sum(h.startswith("linked-") for h in again) == sum(h.startswith("patterns-") for h in again) == 1
    release(spark)
    assert homes(root) == []
    assert savepoint(spark.range(3), "after").count() == 3


@pytest.fixture
def staged(spark, lab, vacc, tmp_path):
    """A crowd with a hot person in files: the inputs, and their stages by person."""
    for name, frame in zip(("lab", "vacc"), crowd(lab, vacc, 900)):
        frame.write.parquet(str(tmp_path / name))
    tests, doses = (spark.read.parquet(str(tmp_path / name)) for name in ("lab", "vacc"))
    root = str(tmp_path / "shared")
    return tests, doses, P.tests_by_person(tests, CFG, root), P.doses_by_person(doses, root), root


def test_rules_and_join_read_stages_by_person_without_an_exchange(spark, staged):
    tests, doses, by_person, doses_by_person, root = staged
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        direct, read = P.analysis_table(tests, doses, CFG), P.analysis_table(by_person, doses_by_person, CFG)
        assert len(exchanges(plan(direct))) == 3
        assert exchanges(plan(read)) == [] and plan(read).count("SortMergeJoin") == 1
        assert "Bucketed: true" in plan(read)
        assert sorted(map(str, read.collect())) == sorted(map(str, direct.collect())) != []
        # Other rules from the same stages, and the same as from the inputs.
        other = replace(CFG, positive_gap=30, outcome_window=14)
        again = P.analysis_table(P.tests_by_person(tests, other, root), doses_by_person, other)
        assert sorted(map(str, again.collect())) == sorted(map(str, P.analysis_table(tests, doses, other).collect()))
        assert len(homes(root)) == 2 and all(len(attempts(root, home)) == 1 for home in homes(root))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_person_is_cut_down_before_its_bucket(spark, staged):
    tests, _, by_person, _, _ = staged
    assert tests.where("id_vigvac = 7").count() == tests.count() // 3
    days = by_person.where("id_vigvac = 7").groupBy("dt_coleta").count().collect()
    assert days and max(r["count"] for r in days) <= 2
    text = plan(P.first_tests(tests, CFG))
    before, after = text.split("Exchange", 1)[1], text.split("Exchange", 1)[0]
    assert "WindowGroupLimit" in before and "Partial" in before and "Final" in after
    assert re.search(r"Exchange hashpartitioning\(id_vigvac#\d+L?, dt_coleta#\d+, confirmado#\d+", text)


def test_bucketed_stages_keep_nulls_and_empty_tables(spark, tmp_path):
    root = str(tmp_path / "shared")
    rows = [(None, "a"), (1, None), (1, "it's"), (None, None)] + [(i, str(i)) for i in range(40)]
    spark.createDataFrame(rows, "id bigint, `odd name` string").write.parquet(str(tmp_path / "rows"))
    frame = spark.read.parquet(str(tmp_path / "rows"))
    kept = bucketed_stage(frame, "rows", "id", root)
    assert kept.schema == frame.schema and sorted(map(str, kept.collect())) == sorted(map(str, frame.collect()))
    assert exchanges(plan(kept.groupBy("id").count())) == []
    empty = bucketed_stage(frame.where("id < 0"), "rows", "id", root)
    assert empty.columns == frame.columns and empty.count() == 0
    loose = bucketed_stage(spark.createDataFrame(rows, "id bigint, x string"), "loose", "id")
    assert loose.count() == len(rows)
    release(spark, root)
    assert homes(root) == [] and not spark.catalog.listTables(pattern="bucketed_*")


def test_a_stage_takes_as_many_tasks_as_its_files_call_for(spark, tmp_path):
    """Not the session's four, each with a quarter of whatever the input is."""
    import glob

    from caselink.session import settings

    raw = str(tmp_path / "raw")
    spark.range(500_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).write.parquet(raw)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes")}
    rows = spark.read.parquet(raw).groupBy("id").agg(F.first("text").alias("text"))
    stage = shared_stage(rows, "wide", str(tmp_path / "stages"))
    assert stage.count() == 500_000
    assert len(glob.glob(f"{tmp_path}/stages/stages/wide-*/attempt-*/part-*")) > 4
    assert {k: spark.conf.get(k, None) for k in before} == before
    with pytest.raises(ValueError), settings(spark, {"spark.sql.files.maxPartitionBytes": "1m"}):
        raise ValueError
    assert spark.conf.get("spark.sql.files.maxPartitionBytes", None) == before["spark.sql.files.maxPartitionBytes"]
