"""Order-dependent rules on a person's tests.

The rules run after ``dedup_tests``, which leaves a person at most two tests per calendar day. That
bounds every per-person window by the length of the study, however many notifications a person had.

Each rule is a boolean column. ``by`` names the columns that form a person's sequence; the ledger adds
a flag there so that removed tests are kept in the frame but not seen by later rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from caselink import config as C
from caselink.config import StudyConfig
from caselink.functions import days_between

PERSON = ["id_vigvac"]
BY_DATE = ["dt_coleta", "confirmado", "rec_id"]


def _sequence(by: Sequence[str], order: Sequence[Column | str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def _whole(window: WindowSpec) -> WindowSpec:
    """All rows of the sequence, sharing the sort of the ordered window."""
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def keep_where(df: DataFrame, rule: Column) -> DataFrame:
    """Filter on a column that may hold window functions; a null outcome drops the row."""
    return df.withColumn("_keep", rule).where("_keep").drop("_keep")


def first_positive_in_window(by: Sequence[str] = PERSON) -> Column:
    window = _whole(_sequence(by, BY_DATE))
    return F.min(F.when(F.col("confirmado") == C.CASE, F.col("dt_coleta"))).over(window)


def days_diff_test(by: Sequence[str] = PERSON, order: Sequence[Column | str] = BY_DATE) -> Column:
    """Days since the person's previous test; null on the first."""
    return days_between("dt_coleta", F.lag("dt_coleta").over(_sequence(by, order)))


def neg_then_pos(cfg: StudyConfig, by: Sequence[str] = PERSON) -> Column:
    """False on a negative whose next test is a positive a few days later."""
    window = _sequence(by, BY_DATE)
    next_result = F.lead("confirmado", 1, C.CONTROL).over(window)
    gap = days_between(F.lead("dt_coleta").over(window), "dt_coleta")
    false_negative = (
        (F.col("confirmado") == C.CONTROL)
        & (next_result == C.CASE)
        & (gap <= cfg.false_negative_gap)
    )
    return ~false_negative


def number_tests(df: DataFrame, by: Sequence[str] = PERSON) -> DataFrame:
    """Add ``seq_no``, the position of each test; same-day ties go by admission date."""
    order = [
        F.col("dt_coleta"), F.col("dt_interna_dt").asc_nulls_last(), F.col("confirmado"), F.col("rec_id")
    ]
    return df.withColumn("seq_no", F.row_number().over(_sequence(by, order)))


def fill_down(df: DataFrame, by: Sequence[str] = PERSON) -> DataFrame:
    """Carry admission and outcome to the person's later rows in admission order.

    Rows without an admission come last, so tests reported by the outpatient system receive what
    the hospital system knows.
    """
    order = [
        F.col("dt_interna_dt").asc_nulls_last(), F.col("dt_coleta"), F.col("confirmado"), F.col("rec_id")
    ]
    window = _sequence(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns(
        {
            c: F.last(c, ignorenulls=True).over(window)
            for c in ["dt_interna_dt", "evolucao", "dt_evoluca"]
        }
    )


def same_result_spacing(
    cfg: StudyConfig, by: Sequence[str] = PERSON, results: Sequence[str] = (C.CONTROL, C.CASE)
) -> Column:
    """Minimum gap to the previous test for persons whose tests all have one result.

    Uses the gap as it was before any removal, so a chain of close tests keeps only its first.
    """
    minimum = {C.CONTROL: cfg.negative_gap, C.CASE: cfg.positive_gap}
    window = _whole(_sequence(by, ["seq_no"]))
    several = F.count("*").over(window) > 1
    gap = F.col("days_diff_test")
    keep = F.lit(True)
    for result in results:
        uniform = F.bool_and(F.col("confirmado") == result).over(window)
        keep = F.when(several & uniform, (gap > minimum[result]) | gap.isNull()).otherwise(keep)
    return keep


def mixed_result_spacing(cfg: StudyConfig, by: Sequence[str] = PERSON) -> Column:
    """Repeat positives too close together, and negatives just before a positive."""
    window = _sequence(by, ["seq_no"])
    count = F.count("*").over(_whole(window))
    result, day = F.col("confirmado"), F.col("dt_coleta")

    def shifted(column: str, rows: int) -> Column:
        return (F.lag(column, rows) if rows > 0 else F.lead(column, -rows)).over(window)

    gap = days_between(day, shifted("dt_coleta", 1))
    return (
        F.when(
            (count > 1) & (shifted("confirmado", 1) == C.CASE) & (result == C.CASE),
            gap > cfg.positive_gap,
        )
        .when(
            (count > 2) & (shifted("confirmado", 2) == C.CASE) & (result == C.CASE),
            days_between(day, shifted("dt_coleta", 2)) > cfg.positive_gap,
        )
        .when(
            (count > 1) & (result == C.CONTROL) & (shifted("confirmado", -1) == C.CASE),
            (days_between(shifted("dt_coleta", -1), day) > cfg.false_negative_gap) | gap.isNull(),
        )
        .otherwise(F.lit(True))
    )


def severe_negative_spacing(cfg: StudyConfig, by: Sequence[str] = PERSON) -> Column:
    """A negative linked to a severe outcome must lie clear of a neighbouring positive.

    Expects ``days_diff_test`` recomputed over the tests still present.
    """
    window = _sequence(by, ["seq_no"])
    severe_control = (
        (F.count("*").over(_whole(window)) > 1)
        & (F.col("outcome") == "Hosp_Death")
        & (F.col("confirmado") == C.CONTROL)
    )
    gap = F.col("days_diff_test")
    return (
        F.when(
            severe_control & (F.lag("confirmado").over(window) == C.CASE),
            (gap > cfg.severe_gap) | gap.isNull(),
        )
        .when(
            severe_control & (F.lead("confirmado").over(window) == C.CASE),
            F.lead("days_diff_test").over(window) > cfg.severe_gap,
        )
        .otherwise(F.lit(True))
    )
