"""Attrition ledger: how many records each preparation step removes and leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselink import config as C
from caselink.config import StudyConfig
from caselink.operators import exposure as E
from caselink.operators import records as R
from caselink.operators import window_rules as W
from caselink.operators.persons import dedup_tests
from caselink.operators.reshape import stack_frames

STEPS = [
    "sample_date", "adult", "onset_floor", "duplicate", "false_negative", "negative_spacing",
    "positive_spacing", "mixed_spacing", "complete", "severe_negative", "vaccine_consistency",
    "one_dose_product", "date_consistency", "valid_categories",
]
SEQUENCE = [*W.PERSON, "_present"]


def _remove(df: DataFrame, step: str, keep: Column) -> DataFrame:
    """Note the step at which a record drops out instead of filtering it.

    The presence flag is part of every window's partition, so later rules see present records only.
    A null outcome removes the record, as a filter would.
    """
    leaves = F.col("_present") & ~F.coalesce(keep, F.lit(False))
    return (
        df.withColumn("_leaves", leaves)
        .withColumn("_step", F.when(F.col("_leaves"), STEPS.index(step)).otherwise(F.col("_step")))
        .withColumn("_present", F.col("_present") & ~F.col("_leaves"))
        .drop("_leaves")
    )


def _start(df: DataFrame) -> DataFrame:
    return df.withColumns({"_step": F.lit(len(STEPS)), "_present": F.lit(True)})


def _first_steps(lab: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Step counts of the row filters before deduplication; needs no shuffle of the records."""
    onset = F.col("dt_inicio_sintomas") > F.lit(cfg.onset_floor)
    return (
        lab.transform(R.impute_dates)
        .transform(_start)
        .transform(_remove, "sample_date", F.col("dt_coleta") > F.lit(cfg.first_sample))
        .transform(_remove, "adult", F.col("idade") >= cfg.min_age)
        .transform(_remove, "onset_floor", onset)
        .groupBy("_step")
        .agg(F.count("*").alias("n"))
    )


def _later_steps(lab: DataFrame, vacc: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Step counts of everything after deduplication in one pass over the distinct tests."""
    complete = F.lit(True)
    for column in R.REQUIRED:
        complete = complete & F.col(column).isNotNull()
    dates = (F.col("dt_coleta") < F.lit(cfg.sample_ceiling)) & (
        F.date_add("dt_coleta", cfg.onset_after_sample) > F.col("dt_inicio_sintomas")
    )
    valid = (
        (F.col("sexo") != "I") & (F.col("sexo") != "NA") & (F.col("uf") != cfg.excluded_state)
    )
    one_dose_twice = (F.col("d1_nome_vacina") == "Ad26") & F.col("vacc_status").startswith("v2")
    return (
        lab.transform(R.study_window, cfg)
        .transform(R.onset_floor, cfg)
        .transform(dedup_tests)
        .transform(_start)
        .transform(_remove, "false_negative", W.neg_then_pos(cfg, SEQUENCE))
        .withColumn("days_diff_test", W.days_diff_test(SEQUENCE))
        .transform(W.number_tests, SEQUENCE)
        .transform(W.fill_down, SEQUENCE)
        .transform(
            _remove, "negative_spacing", W.same_result_spacing(cfg, SEQUENCE, [C.CONTROL])
        )
        .transform(_remove, "positive_spacing", W.same_result_spacing(cfg, SEQUENCE, [C.CASE]))
        .transform(_remove, "mixed_spacing", W.mixed_result_spacing(cfg, SEQUENCE))
        .transform(R.outcome_events, cfg)
        .transform(R.label_records)
        .transform(_remove, "complete", complete)
        .withColumn("days_diff_test", W.days_diff_test(SEQUENCE, ["seq_no"]))
        .transform(_remove, "severe_negative", W.severe_negative_spacing(cfg, SEQUENCE))
        .transform(E.join_vaccination, E.coded_vaccination(vacc, cfg))
        .transform(_remove, "vaccine_consistency", F.col("flag_incon") == 0)
        .transform(E.days_since_dose)
        .transform(E.vacc_status)
        .transform(_remove, "one_dose_product", ~F.coalesce(one_dose_twice, F.lit(False)))
        .transform(_remove, "date_consistency", dates)
        .transform(_remove, "valid_categories", valid)
        .groupBy("_step")
        .agg(F.count("*").alias("n"))
    )


def _left_after(step: str) -> Column:
    """Records that get past a step, from counts by the step of removal."""
    return F.coalesce(F.sum(F.when(F.col("_step") > STEPS.index(step), F.col("n"))), F.lit(0))


def attrition(lab: DataFrame, vacc: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Removed and remaining records per step.

    Row filters are counted in one scan and all later steps in a second; deduplication is the
    difference between the two, since it is not a property of a single record.
    """
    early, late = STEPS[:3], STEPS[4:]
    before = lab.transform(_first_steps, cfg).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input"), *[_left_after(s).alias(s) for s in early]
    )
    after = _later_steps(lab, vacc, cfg).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate"), *[_left_after(s).alias(s) for s in late]
    )
    previous = dict(zip(STEPS, ["input", *STEPS[:-1]]))
    rows = [
        F.struct(
            F.lit(i + 1).cast("bigint").alias("step_no"),
            F.lit(step).alias("step"),
            (F.col(previous[step]) - F.col(step)).alias("removed"),
            F.col(step).alias("remaining"),
        )
        for i, step in enumerate(STEPS)
    ]
    totals = stack_frames(before, after).agg(*[F.max(c).alias(c) for c in ["input", *STEPS]])
    return totals.select(F.inline(F.array(*rows)))
