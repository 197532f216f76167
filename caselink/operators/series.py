"""Histograms, uptake curves, epidemic series and variant shares.

Time series are counted per day first. Windows then run over at most one row per group and day.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselink import config as C
from caselink.config import StudyConfig
from caselink.functions import (
    age_band,
    label_map,
    month_start,
    paste,
    population_of,
    recode,
    week_centre,
)
from caselink.operators import exposure as E
from caselink.operators.levels import lump_levels
from caselink.operators.persons import keep_first
from caselink.operators.records import impute_dates
from caselink.operators.reshape import doses_to_long, stack_frames

# --- histograms -------------------------------------------------------------------------------


def weekly_histogram(
    df: DataFrame, day: str, keys: Sequence[str] = (), start: date | None = None, end: date | None = None
) -> DataFrame:
    """Records per week and key; dates outside the axis limits are left out first."""
    kept = df.where(F.col(day).isNotNull())
    if start is not None:
        kept = kept.where(F.col(day) >= F.lit(start))
    if end is not None:
        kept = kept.where(F.col(day) <= F.lit(end))
    week = F.date_from_unix_date(week_centre(F.unix_date(day)))
    return kept.groupBy(week.alias("week"), *keys).agg(F.count("*").alias("n"))


def case_control_histogram(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Samples per week, product group and case status on the axis of the case-control figures."""
    return weekly_histogram(
        df, "dt_coleta", ["vs_type3", "confirmado"], cfg.case_control_start, cfg.case_control_end
    )


def number_histogram(df: DataFrame, value: str, low: int, high: int, width: int = 7) -> DataFrame:
    """Records per bin of an integer column within the axis limits."""
    return (
        df.where(F.col(value).between(low, high))
        .groupBy(week_centre(value, width).alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def first_records(df: DataFrame) -> DataFrame:
    """Each person's first record of the analysis table."""
    return keep_first(df, ["id_vigvac"], ["seq_no"])


def interval_histogram(df: DataFrame) -> DataFrame:
    """Days from second dose to booster, one record per person of the two-dose course."""
    return (
        df.where(F.col("tipo_teste") == C.PCR)
        .transform(first_records)
        .where((F.col("d1_nome_vacina") == "CV") & (F.col("time_2nd_3rd") > 90))
        .transform(number_histogram, "time_2nd_3rd", 0, 300)
    )


def booster_delay_bar(df: DataFrame) -> DataFrame:
    """Days from booster to onset by age group, one record per boosted person."""
    label = F.col("vs_type2")
    return (
        df.where(F.col("tipo_teste") == C.PCR)
        .transform(first_records)
        .where(label.contains("CV_v3") & label.contains("BNT"))
        .where(F.col("days_vacc_3_test").between(0, 60))
        .groupBy("days_vacc_3_test", age_band("idade", C.MODEL_BANDS).alias("idade_cat"))
        .agg(F.count("*").alias("n"))
    )


# --- running totals and date grids ------------------------------------------------------------


def running_total(groups: Sequence[str], order: Column, value: str = "n") -> Column:
    window = Window.partitionBy(*groups).orderBy(order)
    return F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def complete_days(
    df: DataFrame, groups: Sequence[str], day: str, end: date, carry: Sequence[str]
) -> DataFrame:
    """Add a row for every day from a group's first one to ``end`` and carry values forward.

    ``df`` has one row per group and day with numeric values. Its own days after ``end`` stay.
    """
    values = [c for c in df.columns if c not in (*groups, day)]
    first = df.groupBy(*groups).agg(F.min(day).alias("_first"))
    days = F.when(F.col("_first") <= F.lit(end), F.sequence("_first", F.lit(end)))
    grid = first.select(*groups, F.explode(days).alias(day))
    window = Window.partitionBy(*groups).orderBy(day)
    return (
        stack_frames(df, grid)
        .groupBy(*groups, day)
        .agg(*[F.max(v).alias(v) for v in values])
        .withColumns({c: F.last(c, ignorenulls=True).over(window) for c in carry})
    )


def month_sequence(start: date, end: date, months: int = 1) -> Column:
    """Axis dates from ``start``, every so many months."""
    return F.sequence(F.lit(start), F.lit(end), F.make_interval(F.lit(0), F.lit(months)))


def monthly_counts(df: DataFrame, day: str, start: date, end: date, months: int = 1) -> DataFrame:
    """``axis_date, n``: rows per step of so many months from ``start``, steps without rows included.

    Rows before ``start`` or after ``end`` are not counted.
    """
    counted = df.where(F.col(day).between(F.lit(start), F.lit(end))).groupBy(day).agg(F.count("*").alias("n"))
    axis = month_sequence(start, end, months)
    # The last axis date that is not after the day.
    at = F.array_max(F.filter(axis, lambda x: x <= F.col(day)))
    seen = counted.groupBy(at.alias("axis_date")).agg(F.sum("n").alias("n"))
    grid = df.sparkSession.range(1).select(F.explode(axis).alias("axis_date"))
    return grid.join(seen, "axis_date", "left").select("axis_date", F.coalesce("n", F.lit(0)).alias("n"))


# --- vaccine uptake ---------------------------------------------------------------------------


def uptake_daily(vacc: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Doses per day, dose number, age band and whether the person is on the inactivated course."""
    consistent = (
        vacc.transform(E.vaccinated_persons)
        .transform(E.vaccine_consistency, cfg, check_age=True)
        .withColumn("is_cv", F.col("d1_nome_vacina") == C.CORONAVAC)
    )
    floor = label_map("dose", {dose: day for dose, day in cfg.uptake_floor.items()})
    return (
        doses_to_long(consistent.withColumn("faixa_etaria", age_band("d_idade", C.UPTAKE_BANDS)),
                      ["faixa_etaria", "is_cv"], E.DOSES)
        .where((F.col("data") > floor) & (F.col("data") < F.lit(cfg.uptake_ceiling)))
        .groupBy("dose", "faixa_etaria", "is_cv", "data")
        .agg(F.count("*").alias("n"))
    )


def uptake_cumulative(vacc: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Coverage curve per dose and age band, for everyone and for the inactivated course."""
    groups = ["course", "dose", "faixa_etaria"]
    courses = F.when(F.col("is_cv"), F.array(F.lit("all"), F.lit("CoronaVac"))).otherwise(
        F.array(F.lit("all"))
    )
    return (
        vacc.transform(uptake_daily, cfg)
        .withColumn("course", F.explode(courses))
        .groupBy(*groups, "data")
        .agg(F.sum("n").alias("n"))
        .withColumn("cumulative", running_total(groups, F.col("data")))
        .withColumn(
            "coverage", F.col("cumulative") / population_of("faixa_etaria", C.POPULATION)
        )
    )


def booster_mix(vacc: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Booster product after the inactivated course: cumulative share of boosted courses by day."""
    boosted = (
        vacc.transform(E.vaccinated_persons)
        .transform(E.vaccine_consistency, cfg, check_age=True)
        .where(F.col("d1_nome_vacina") == C.CORONAVAC)
        .where(
            (F.col("d3_data_aplicacao") > F.lit(cfg.uptake_floor["d3_data_aplicacao"]))
            & (F.col("d3_data_aplicacao") < F.lit(cfg.grid_end))
        )
        .transform(E.recode_products)
    )
    course = paste("d1_nome_vacina", "d3_nome_vacina", sep="")
    labels = {f"CV{code}": label for code, label in C.CODE_LABELS.items()}
    daily = (
        boosted.groupBy(label_map(course, labels).alias("booster"), F.col("d3_data_aplicacao").alias("data"))
        .agg(F.count("*").alias("n"))
        .withColumn("cumulative", running_total(["booster"], F.col("data")))
        .withColumn(
            "share",
            F.when(F.col("booster").isNotNull(), F.col("cumulative") / C.BOOSTED_COURSES),
        )
    )
    return complete_days(daily, ["booster"], "data", cfg.grid_end, carry=["share"])


def primary_courses(vacc: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Doses 1 and 2 in long form with product labels; products licensed later start later."""
    labelled = (
        vacc.transform(E.vaccinated_persons)
        .transform(E.vaccine_consistency, cfg, check_age=True)
        .where(F.col("d_idade") >= cfg.min_vaccine_age)
        .withColumns(
            {c: label_map(c, C.PRODUCT_LABELS) for c in ["d1_nome_vacina", "d2_nome_vacina"]}
        )
    )
    product, second = F.col("d1_nome_vacina"), F.col("d2_nome_vacina")
    late = product.contains("Ad26") | product.contains("BNT")
    in_time = F.when(late, F.col("d1_data_aplicacao") > F.lit(cfg.late_product_floor)).otherwise(
        F.lit(True)
    )
    kept = labelled.where((second != "Ad26.COV2.S") | second.isNull()).where(in_time)
    return doses_to_long(kept, ["id_vigvac", "d1_nome_vacina", "d_idade"], E.DOSES[:2])


def uptake_by_product(vacc: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Coverage by product, dose and age band; doses not given are counted under a null date, last."""
    groups = ["d1_nome_vacina", "dose", "faixa_etaria"]
    return (
        vacc.transform(primary_courses, cfg)
        .withColumn("faixa_etaria", age_band("d_idade", C.UPTAKE_BANDS_60))
        .groupBy(*groups, "data")
        .agg(F.count("*").alias("n"))
        .withColumn("cumulative", running_total(groups, F.col("data").asc_nulls_last()))
        .withColumn(
            "coverage", F.col("cumulative") / population_of("faixa_etaria", C.POPULATION_60)
        )
    )


def uptake_filled(vacc: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The product curves on a full daily grid."""
    curves = vacc.transform(uptake_by_product, cfg).where(F.col("data").isNotNull())
    return complete_days(
        curves, ["d1_nome_vacina", "dose", "faixa_etaria"], "data", cfg.grid_end, carry=["coverage"]
    )


def uptake_by_product_all(vacc: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Coverage by product and dose over all ages."""
    groups = ["d1_nome_vacina", "dose"]
    return (
        vacc.transform(primary_courses, cfg)
        .groupBy(*groups, "data")
        .agg(F.count("*").alias("n"))
        .withColumn("cumulative", running_total(groups, F.col("data").asc_nulls_last()))
        .withColumn("coverage", F.col("cumulative") / C.POPULATION_ALL)
    )


def second_dose_missing(vacc: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Persons on the inactivated course by age band and whether dose 2 is unrecorded."""
    first = F.col("d1_data_aplicacao")
    return (
        vacc.transform(E.vaccinated_persons)
        .where(
            (first > F.lit(cfg.uptake_floor["d1_data_aplicacao"]))
            & (first < F.lit(cfg.uptake_ceiling))
            & (F.col("d1_nome_vacina") == C.CORONAVAC)
        )
        .groupBy(
            age_band("d_idade", C.UPTAKE_BANDS).alias("faixa_etaria"),
            F.col("d2_nome_vacina").isNull().alias("d2_missing"),
        )
        .agg(F.count("*").alias("n"))
    )


# --- epidemic series --------------------------------------------------------------------------


def notified_tests(lab: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Tests with dates imputed, notified in the study and not long before onset."""
    return (
        lab.transform(impute_dates)
        .where(F.col("dt_notificacao") > F.lit(cfg.series_floor))
        .where(
            F.date_add("dt_notificacao", cfg.onset_after_notification)
            >= F.col("dt_inicio_sintomas")
        )
    )


EVENT_COLUMNS = ["rec_id", "id_vigvac", "confirmado", "dt_interna_dt", "evolucao", "dt_evoluca"]


def event_records(tests: DataFrame, samples: bool = False) -> DataFrame:
    """Per person, admission date and result, the first record and the one of the earliest outcome:
    ``id_vigvac, confirmado, of, day, first, ended`` with ``of`` = ``admission``.

    No admission date forms a group too. With ``samples`` the cases are also grouped by sample date
    (``of`` = ``sample``), from the same read and in the same exchange. Partial minima keep a person
    with very many records from filling a task.
    """
    record = F.struct(*EVENT_COLUMNS, "dt_inicio_sintomas")
    outcome_order = F.struct(F.col("dt_evoluca").isNull(), "dt_evoluca", "rec_id")
    groups = [F.struct(F.lit("admission").alias("of"), F.col("dt_interna_dt").alias("day"))]
    if samples:
        by_sample = F.struct(F.lit("sample").alias("of"), F.col("dt_coleta").alias("day"))
        groups.append(F.when(F.col("confirmado") == C.CASE, by_sample))
    return (
        tests.withColumn("group", F.explode(F.array_compact(F.array(*groups))))
        .groupBy("id_vigvac", "confirmado", "group.of", "group.day")
        .agg(F.min_by(record, "rec_id").alias("first"), F.min_by(record, outcome_order).alias("ended"))
    )


def _died() -> Column:
    """Fatal cases, by the earliest outcome per person, admission date and result."""
    return (F.col("confirmado") == C.CASE) & F.col("ended.evolucao").isin("2", "3")


def _death_alone(admitted: Column) -> Column:
    """Deaths of persons without an admission; who has no id is never known to have had one."""
    return _died() & ~(F.col("id_vigvac").isNotNull() & admitted)


def severe_outcomes(lab: DataFrame, cfg: StudyConfig, admitted_only: bool = False) -> DataFrame:
    """Admissions plus deaths of persons without one, dated by admission or else outcome.

    Records without an admission date count as admissions here, as in the original analysis;
    ``admitted_only`` leaves them out.
    """
    events = lab.transform(notified_tests, cfg).transform(event_records)
    counts = F.lit(True)
    if admitted_only:
        counts = F.col("day").isNotNull()
        person = Window.partitionBy("id_vigvac")
        events = events.withColumn("admitted", F.max(counts).over(person))
    else:
        events = events.withColumn("admitted", counts)
    both = F.array(F.when(counts, F.col("first")), F.when(_death_alone(F.col("admitted")), F.col("ended")))
    return (
        events.select(F.explode(F.array_compact(both)).alias("event"))
        .select(*[f"event.{c}" for c in EVENT_COLUMNS])
        .withColumn("data_severe", F.coalesce("dt_interna_dt", "dt_evoluca"))
    )


def severe_series(lab: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Weekly severe outcomes of all results whose outcome date lies before the ceiling."""
    kept = lab.transform(severe_outcomes, cfg).where(
        (F.col("data_severe") > F.lit(cfg.event_floor)) & (F.col("dt_evoluca") < F.lit(cfg.event_ceiling))
    )
    return weekly_histogram(kept, "data_severe", start=cfg.axis_start, end=cfg.grid_end)


def epidemic_series(lab: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Weekly infections, admissions, deaths and severe outcomes of cases.

    One read and one exchange of the notifications: each group of a person gives the dates of the
    series that it counts in, and those are counted by week.
    """
    case = F.col("confirmado") == C.CASE
    admission = F.col("of") == "admission"
    first, ended = F.col("first"), F.col("ended")

    def severe_day(record: Column) -> Column:
        return F.coalesce(record["dt_interna_dt"], record["dt_evoluca"])

    def point(series: str, counts: Column, day: Column, end: date, low: date | None = None, high: date | None = None) -> Column:
        """A day between both bounds, exclusive, on an axis that holds its ``end``."""
        kept = counts & (day <= F.lit(end))
        if low is not None:
            kept = kept & (day > F.lit(low)) & (day < F.lit(high))
        return F.when(kept, F.struct(F.lit(series).alias("series"), day.alias("day")))

    severe = (cfg.grid_end, cfg.severe_floor, cfg.grid_end)
    points = F.array(
        point("infection", case & (F.col("of") == "sample"), first["dt_inicio_sintomas"], cfg.axis_end),
        point("hospitalization", case & admission, first["dt_interna_dt"], cfg.axis_end, cfg.event_floor, cfg.grid_end),
        point("death", admission & _died(), ended["dt_evoluca"], cfg.grid_end, cfg.event_floor, cfg.event_ceiling),
        point("severe", case & admission, severe_day(first), *severe),
        point("severe", admission & _death_alone(F.lit(True)), severe_day(ended), *severe),
    )
    dated = (
        lab.transform(notified_tests, cfg)
        .transform(event_records, samples=True)
        .select(F.explode(F.array_compact(points)).alias("point"))
        .select("point.*")
    )
    return weekly_histogram(dated, "day", ["series"], start=cfg.axis_start).select("series", "week", "n")


# --- variants ---------------------------------------------------------------------------------


def variant_families(df: DataFrame) -> DataFrame:
    """Lineage names reduced to families."""
    name = F.col("variante")
    return df.withColumn(
        "variante",
        F.when(F.col("classificacao") == "Não VOC/VOI", "Non VOC/VOI")
        .when(name.contains("Gama"), "Gamma")
        .when(name.contains("Delta"), "Delta")
        .otherwise(name),
    )


def lumped_variants(df: DataFrame, keep: int = 3) -> DataFrame:
    """Families with the rest lumped by weight, months and regions recoded."""
    return (
        df.transform(variant_families)
        .transform(lump_levels, "variante", keep=keep, weight="quantidade")
        .withColumns(
            {
                "periodo": month_start("periodo", C.MONTHS),
                "regiao": recode("regiao", C.REGION_LABELS),
            }
        )
    )


def variant_share(df: DataFrame, keep: int = 3) -> DataFrame:
    """Sequenced samples per month, region and family, and their share of the month and region."""
    total = F.sum("n").over(Window.partitionBy("periodo", "regiao"))
    return (
        df.transform(lumped_variants, keep)
        .groupBy("periodo", "regiao", "variante")
        .agg(F.sum("quantidade").alias("n"))
        .withColumn("share", F.try_divide(F.col("n"), total))
    )
