"""Frequency, exposure and baseline tables.

Records are first counted by the few categorical columns a table needs; cohorts, strata and overall
columns are then derived from those counts, so the data are read and shuffled once per table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselink import config as C
from caselink.functions import bigint, label_map, rounded
from caselink.operators.cohorts import COHORT_COLUMNS, expand_cohorts, with_age_groups
from caselink.operators.persons import first_of_person
from caselink.operators.quantiles import exact_quantiles, same_keys

Z_95 = 1.959963984540054

TABLE_CATEGORIES = [
    "sexo", "raca", "idade_cat", "tipo_teste", "macro_region", "n_comorb", "prev_infected",
    "hosp_event", "death_event", "outcome", "vs_type3",
]
TABLE_FLAGS = [*C.FLAGS, "unique_id"]


def freq_with_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One-way counts of each column, null kept as a level."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return (
        text.unpivot([], list(columns), "variable", "level")
        .groupBy("variable", "level")
        .agg(F.count("*").alias("n"))
    )


def exposure_order() -> dict[str, int]:
    terms = [C.NEVER_VACCINATED] + [f"CV_{t}" for t in C.exposure_terms()]
    return {term: rank for rank, term in enumerate(terms)}


def exposure_counts(df: DataFrame) -> DataFrame:
    """Cases and controls per exposure, age group and cohort column."""
    return (
        df.transform(with_age_groups)
        .groupBy("vs_type2", "idade_cat", "confirmado", *COHORT_COLUMNS)
        .agg(F.count("*").alias("n"))
    )


def reported_exposures(df: DataFrame, product: str = "CV", booster: str = "BNT") -> DataFrame:
    """Unvaccinated and one product's labels, boosted only with the given booster."""
    label = F.col("vs_type2")
    boosted = F.when(label.contains("_v3_"), label.contains(booster)).otherwise(F.lit(True))
    return df.where(boosted & (label.contains(f"{product}_") | label.contains(C.NEVER_VACCINATED)))


def case_control_counts(
    df: DataFrame, by_age: bool = False, cohorts: Sequence[str] | None = None
) -> DataFrame:
    """One row per cohort and exposure with its cases and controls, zero cells included."""
    return df.transform(exposure_counts).transform(case_control_of_counts, by_age, cohorts)


def case_control_of_counts(
    counts: DataFrame, by_age: bool = False, cohorts: Sequence[str] | None = None
) -> DataFrame:
    """The same from a frame already counted by :func:`exposure_counts`."""
    keys = ["cohort", *(["idade_cat"] if by_age else []), "vs_type2"]
    return (
        counts.transform(expand_cohorts, cohorts)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum(F.when(F.col("confirmado") == C.CASE, F.col("n"))), F.lit(0)).alias("cases"),
            F.coalesce(F.sum(F.when(F.col("confirmado") == C.CONTROL, F.col("n"))), F.lit(0)).alias(
                "controls"
            ),
        )
    )


def exposure_by_outcome(
    df: DataFrame, by_age: bool = False, cohorts: Sequence[str] | None = None
) -> DataFrame:
    """Exposure against case status with row and column percentages and an overall column."""
    groups = ["cohort", *(["idade_cat"] if by_age else [])]
    strata = {C.CASE: F.col("cases"), C.CONTROL: F.col("controls"), "Overall": F.col("total")}
    cells = F.array(
        *[F.struct(F.lit(name).alias("stratum"), n.alias("n")) for name, n in strata.items()]
    )
    column_total = F.sum("n").over(Window.partitionBy(*groups, "stratum"))
    return (
        df.transform(case_control_counts, by_age, cohorts)
        .transform(reported_exposures)
        .withColumn("total", F.col("cases") + F.col("controls"))
        .select(*groups, "vs_type2", "total", F.inline(cells))
        .select(
            *groups,
            "vs_type2",
            bigint(label_map("vs_type2", exposure_order())).alias("term_rank"),
            "stratum",
            "n",
            rounded(100 * F.col("n") / F.col("total")).alias("row_pct"),
            rounded(F.try_divide(100 * F.col("n"), column_total)).alias("col_pct"),
        )
    )


def crude_or(
    df: DataFrame,
    reference: str = C.NEVER_VACCINATED,
    by_age: bool = False,
    cohorts: Sequence[str] | None = None,
) -> DataFrame:
    """Odds ratio of each exposure against the reference with a Wald interval.

    Null where a cell is empty. All exposures are compared, not only the reported ones.
    """
    return crude_or_of_counts(df.transform(exposure_counts), reference, by_age, cohorts)


def crude_or_of_counts(
    exposures: DataFrame,
    reference: str = C.NEVER_VACCINATED,
    by_age: bool = False,
    cohorts: Sequence[str] | None = None,
) -> DataFrame:
    """The same from a frame already counted by :func:`exposure_counts`."""
    groups = ["cohort", *(["idade_cat"] if by_age else [])]
    counts = exposures.transform(case_control_of_counts, by_age, cohorts)
    window = Window.partitionBy(*groups)

    def of_reference(column: str):
        return F.max(F.when(F.col("vs_type2") == reference, F.col(column))).over(window)

    cells = ["cases", "controls", "ref_cases", "ref_controls"]
    full = F.least(*cells) > 0
    a, b, c, d = (F.col(x).cast("double") for x in cells)
    log_or = F.when(full, F.log(a * d / (b * c)))
    se = F.when(full, F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
    return (
        counts.withColumns(
            {"ref_cases": of_reference("cases"), "ref_controls": of_reference("controls")}
        )
        .where(F.col("vs_type2") != reference)
        .withColumns({"estimate": log_or, "std_error": se})
        .withColumns(
            {
                "odds_ratio": F.exp("estimate"),
                "or_lower": F.exp(F.col("estimate") - Z_95 * F.col("std_error")),
                "or_upper": F.exp(F.col("estimate") + Z_95 * F.col("std_error")),
            }
        )
    )


def unique_persons(df: DataFrame, stratum: str) -> DataFrame:
    """Records, and persons counted in the stratum of their first record only."""
    return (
        df.withColumn("_first", first_of_person(["seq_no"]))
        .groupBy(F.col(stratum).alias("stratum"))
        .agg(F.count("*").alias("records"), F.count_if("_first").alias("persons"))
    )


def baseline_columns(df: DataFrame) -> DataFrame:
    """Columns the baseline table describes that are not in the analysis table."""
    return df.transform(with_age_groups).withColumn(
        "unique_id", first_of_person(["seq_no"]).cast("int")
    )


def _by_stratum(values: Sequence[str], by: str, column, function) -> Mapping:
    cells = {v: function(F.when(F.col(by) == v, column)) for v in values}
    return {**cells, "Overall": function(F.when(F.col(by).isin(list(values)), column))}


def baseline_table(
    df: DataFrame,
    by: str = "confirmado",
    by_values: Sequence[str] = (C.CASE, C.CONTROL),
    categories: Sequence[str] = tuple(TABLE_CATEGORIES),
    flags: Sequence[str] = tuple(TABLE_FLAGS),
    numbers: Sequence[str] = ("idade",),
    strata: Sequence[str] = (),
) -> DataFrame:
    """Characteristics by stratum and overall.

    Categories give n and column percent of the known values, with unknown as its own level; flags
    report level 1 only; numbers give quartiles. ``n_known`` is the number of known values.
    """
    described = [*categories, *flags]
    keys = [*strata, "variable", "level"]
    text = df.select(*strata, by, *[F.col(c).cast("string").alias(c) for c in described])
    counts = (
        text.unpivot([*strata, by], described, "variable", "level")
        .groupBy(*keys)
        .agg(*[n.alias(v) for v, n in _by_stratum(by_values, by, F.lit(1), F.count).items()])
    )
    columns = [*by_values, "Overall"]
    known = F.sum(F.when(F.col("level").isNotNull(), F.col("n"))).over(
        Window.partitionBy(*strata, "variable", "stratum")
    )
    categorical = (
        counts.unpivot(keys, columns, "stratum", "n")
        .withColumn("n_known", F.coalesce(known, F.lit(0)))
        .where(~F.col("variable").isin(list(flags)) | (F.col("level") == "1") | F.col("level").isNull())
        .select(
            *strata,
            "variable",
            F.coalesce("level", F.lit("Unknown")).alias("level"),
            "stratum",
            "n",
            "n_known",
            rounded(
                F.when(F.col("level").isNotNull(), F.try_divide(100 * F.col("n"), F.col("n_known")))
            ).alias("stat"),
        )
    )
    if not numbers:
        return categorical
    return categorical.unionByName(_quartiles(df, by, by_values, numbers, strata))


def _quartiles(df, by, by_values, numbers, strata) -> DataFrame:
    """Quartile rows of all strata at once, exact in bounded memory."""
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    own = F.when(F.col(by).isin(list(by_values)), F.col(by))
    cells = [
        F.struct(F.lit(number).alias("variable"), stratum.alias("stratum"), F.col(number).cast("double").alias("value"))
        for number in numbers
        for stratum in (own, F.when(own.isNotNull(), F.lit("Overall")))
    ]
    values = df.select(*strata, F.inline(F.array(*cells))).where(F.col("stratum").isNotNull())
    found = exact_quantiles(values, [*strata, "variable", "stratum"], "value", list(quartiles.values()))
    grid = F.array(
        *[
            F.struct(F.lit(number).alias("variable"), F.lit(level).alias("level"), F.lit(i).alias("place"), F.lit(stratum).alias("stratum"))
            for number in numbers
            for i, level in enumerate(quartiles)
            for stratum in [*by_values, "Overall"]
        ]
    )
    groups = df.select(*strata).distinct() if strata else df.sparkSession.range(1)
    rows = groups.select(*strata, F.inline(grid))
    keys = [*strata, "variable", "stratum"]
    named = found.select(*[F.col(k).alias("_" + k) for k in keys], F.col("n").alias("_n"), "quantiles")
    n = F.coalesce("_n", F.lit(0))
    return rows.join(named, same_keys(keys), "left").select(
        *strata, "variable", "level", "stratum", n.alias("n"), n.alias("n_known"), rounded(F.get("quantiles", F.col("place"))).alias("stat")
    )
