"""First-record selection and person-level features.

Every selection here combines on the map side (a rank limit or a partial aggregate), so a person or
key with a very large share of the rows reaches its reducer as at most one row per input task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselink import config as C
from caselink.operators.reshape import map_columns
from caselink.session import savepoint


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row per key tuple in a total order; null keys form one group."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") == 1).drop("_rn")


def dedup_tests(df: DataFrame) -> DataFrame:
    """One record per person, sample date and result."""
    return keep_first(df, ["id_vigvac", "dt_coleta", "confirmado"], ["rec_id"])


def first_positive(df: DataFrame) -> DataFrame:
    """Date of each person's first positive test."""
    return (
        df.where(F.col("confirmado") == C.CASE)
        .groupBy("id_vigvac")
        .agg(F.min("dt_coleta").alias("firstcasedate"))
    )


def attach_first_positive(df: DataFrame) -> DataFrame:
    """Every record with its person's first positive date (null if never positive).

    The dates are written first: both join sides are then plain exchanges, and adaptive execution
    splits the records of a person who has very many.
    """
    return df.join(savepoint(first_positive(df), "first_positive"), "id_vigvac", "left")


def first_known_value(df: DataFrame, value: str = "raca") -> DataFrame:
    """Earliest non-null value per person; on one day the hospital record goes first."""
    known = df.where(F.col(value).isNotNull())
    order = ["dt_notificacao", F.col("sistema").desc(), "rec_id"]
    return keep_first(known, ["id_vigvac"], order).select("id_vigvac", value)


def _any_flag(flags: Sequence[str]) -> list[Column]:
    return [F.when(F.sum(c) > 0, 1).when(F.sum(c).isNotNull(), 0).alias(c) for c in flags]


def person_comorbidities(df: DataFrame, flags: Sequence[str] = tuple(C.COMORBIDITIES)) -> DataFrame:
    """1 if any record of the person has the flag, 0 if all known ones do not, null if none is known."""
    return df.groupBy("id_vigvac").agg(*_any_flag(flags))


def person_features(df: DataFrame) -> DataFrame:
    """Notifications with person-level comorbidities and first known race in place of their own.

    The persons are written first, so that a person's many records can be split over join tasks.
    """
    known_race = F.when(
        F.col("raca").isNotNull(),
        F.struct("dt_notificacao", (F.col("sistema") == "sg").alias("late"), "rec_id", "raca"),
    )
    persons = df.groupBy("id_vigvac").agg(
        *_any_flag(C.COMORBIDITIES), F.min(known_race)["raca"].alias("raca"),
    )
    notifications = df.drop("raca", *C.COMORBIDITIES)
    return notifications.join(savepoint(persons, "person_features"), "id_vigvac", "left")


def flags_fill_zero(df: DataFrame, flags: Sequence[str] = tuple(C.FLAGS)) -> DataFrame:
    """Unknown flags become 0."""
    return map_columns(df, flags, lambda c: F.coalesce(c, F.lit(0)))


def first_of_person(order: Sequence[str]) -> Column:
    """True on a person's first record. Needs a bounded number of records per person."""
    return F.row_number().over(Window.partitionBy("id_vigvac").orderBy(*order)) == 1
