"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracle import TABLES, compare, spark_table  # noqa: E402

SF = "/root/testdata/sf0.001"
#: The smallest tables hold too few deaths for a model of deaths to converge.
MODEL_SF = "/root/testdata/sf0.01"
# Training-data queries have tests of their own.
ORACLE = {k: v for k, v in entry_point.oracle_sql().items() if k not in entry_point.LLM_QUERIES}
QUERIES = {k: v for k, v in entry_point.queries().items() if k not in entry_point.LLM_QUERIES}
MODELS = ["ve_model", "ve_confounder_ladder", "ve_by_outcome", "ve_by_age", "ve_reference_change", "ve_antigen", "ve_by_outcome_bias_reduced"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def connect(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


@pytest.fixture(scope="module")
def connections():
    return {folder: connect(folder) for folder in (SF, MODEL_SF)}


def test_only_fitted_models_have_no_sql():
    assert sorted(set(QUERIES) - set(ORACLE)) == sorted(MODELS)
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, connections, name):
    folder = MODEL_SF if name.endswith("_scores") else SF
    rows = spark_table(QUERIES[name](spark, folder))
    cursor = connections[folder].execute(ORACLE[name])
    expected = pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description], dtype=object)
    assert compare(rows, expected) == "ok"


@pytest.mark.parametrize("name", MODELS)
def test_models_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry_point.entry(spark)
    assert "vs_type2" in df.columns and df.count() > 0


def test_no_record_is_left_out_of_the_long_form(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert QUERIES["wide_to_long_multi"](spark, SF).count() == orders
    flow = QUERIES["notification_flow"](spark, SF)
    assert flow.count() == 2 * orders
