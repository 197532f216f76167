"""Every operator as a query over the fixture relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselink import config as C
from caselink import models
from caselink.functions import age_band, rounded
from caselink.operators import classify, cohorts, exposure, persons, records, regions, reshape
from caselink.operators import levels as L
from caselink.operators import series as S
from caselink.operators import tables
from caselink.operators import window_rules as W
from caselink.plans import cohort as P
from caselink.plans import ledger
from caselink.session import savepoint, scratch_folder, tune
from caselink.sources import (
    CARRIER_STUDY,
    carrier,
    read_lookup,
    read_parquet,
    read_tagged,
    read_wide_table,
)

CFG = CARRIER_STUDY
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(digits: int = 6):
    """Register a query; its integers come back as bigint and its doubles rounded."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain(fn(tune(spark), sf_dir), digits)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        return fn

    return register


def _plain(df: DataFrame, digits: int) -> DataFrame:
    columns = []
    for f in df.schema:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.DecimalType)):
            column = rounded(column, digits)
        columns.append(column.alias(f.name))
    return df.select(*columns)


def _lab(spark, sf_dir):
    return carrier(spark, sf_dir, "lab")


def _vacc(spark, sf_dir):
    return carrier(spark, sf_dir, "vacc")


def _linked(spark, sf_dir):
    return (
        _lab(spark, sf_dir)
        .transform(P.clean_tests, CFG)
        .transform(P.link_vaccination, _vacc(spark, sf_dir), CFG)
    )


def _analysis(spark, sf_dir):
    return P.analysis_table(_lab(spark, sf_dir), _vacc(spark, sf_dir), CFG)


def _notifications(spark, sf_dir):
    return classify.harmonise_notifications(
        carrier(spark, sf_dir, "sg_raw"), carrier(spark, sf_dir, "srag_raw"), CFG
    )


def _variants(spark, sf_dir):
    """The surveillance table, kept because lumping reads it twice."""
    return savepoint(carrier(spark, sf_dir, "variants"), "variants")


def _patterns(spark, sf_dir):
    return models.compress(P.prepare_rows(_lab(spark, sf_dir), _vacc(spark, sf_dir), CFG))


# --- sources and sinks ------------------------------------------------------------------------


@query()
def scan_registry(spark, sf_dir):
    """Column-pruned, filtered parquet scan."""
    orders = read_parquet(
        spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"]
    )
    return orders.where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("rec_id"),
        F.col("o_custkey").alias("id_vigvac"),
        F.to_date("o_orderdate").alias("dt_notificacao"),
    )


@query()
def savepoint_roundtrip(spark, sf_dir):
    """A stage written to the shared folder and read back."""
    imputed = _lab(spark, sf_dir).transform(records.impute_dates)
    return savepoint(imputed, "imputed").select(
        "rec_id", "id_vigvac", "dt_coleta", "dt_inicio_sintomas", "confirmado"
    )


@query()
def part_files(spark, sf_dir):
    """All part files of a table, out of a folder that holds other files too."""
    root = scratch_folder(spark, "parts")
    rows = _lab(spark, sf_dir).select("rec_id", "dt_coleta", "confirmado")
    rows.repartition(4, "rec_id").write.parquet(root)
    rows.where("false").coalesce(1).write.mode("append").option("header", True).csv(root)
    return read_parquet(spark, root, part_glob="part-*.parquet", schema=rows.schema)


@query()
def tagged_union(spark, sf_dir):
    """Result sheets in one folder, read as one table tagged with the sheet name."""
    counts = savepoint(_analysis(spark, sf_dir).transform(tables.case_control_counts), "counts")
    root = scratch_folder(spark, "sheets")
    for name in models.effectiveness.OUTCOMES:
        sheet = counts.where(F.col("cohort") == name).drop("cohort")
        sheet.write.parquet(f"{root}/{name}.parquet")
    return read_tagged(spark, root)


@query()
def clean_column_names(spark, sf_dir):
    """Surveillance table with free-form headers brought to plain names."""
    raw = carrier(spark, sf_dir, "variants").withColumnsRenamed(
        {"periodo": "Período", "regiao": "Região ", "variante": "VARIANTE", "classificacao": "Classificação",
         "quantidade": "Quantidade (n)"}
    )
    path = scratch_folder(spark, "surveillance")
    raw.write.csv(path, header=True, sep=";")
    return read_wide_table(spark, path, sep=";").withColumn(
        "quantidade_n", F.col("quantidade_n").cast("bigint")
    )


@query()
def region_lookup_join(spark, sf_dir):
    """Micro-regions from a headed CSV lookup whose codes keep their leading zeros."""
    lookup = carrier(spark, sf_dir, "mun_region")
    path = scratch_folder(spark, "lookup")
    lookup.write.csv(path, header=True)
    lab = _lab(spark, sf_dir).select("rec_id", "cod_ibge")
    return regions.region_lookup_join(lab, read_lookup(spark, path, lookup.schema), CFG)


# --- projections and reshaping ----------------------------------------------------------------


@query()
def project_columns(spark, sf_dir):
    return reshape.without(_lab(spark, sf_dir), *C.FLAGS, "evolucao", "dt_evoluca", "dt_interna_dt")


@query()
def wide_to_long_multi(spark, sf_dir):
    wide = carrier(spark, sf_dir, "registry_wide")
    return reshape.wide_to_long(wide, ["id_vigvac"], "sg_dt_datanotificacao")


@query()
def dose_unpivot(spark, sf_dir):
    keys = ["id_vigvac", "d1_nome_vacina", "d_idade"]
    return reshape.doses_to_long(_vacc(spark, sf_dir), keys, exposure.DOSES)


@query()
def n_comorb(spark, sf_dir):
    return _lab(spark, sf_dir).select("rec_id", reshape.row_sum(C.COMORBIDITIES).alias("n_comorb"))


@query()
def notification_flow(spark, sf_dir):
    outpatient = reshape.wide_to_long(
        carrier(spark, sf_dir, "registry_wide"), ["id_vigvac"], "sg_dt_datanotificacao"
    )
    return classify.notification_flow(outpatient, carrier(spark, sf_dir, "srag_raw"))


@query()
def harmonise_notifications(spark, sf_dir):
    return _notifications(spark, sf_dir)


@query()
def classify_outpatient(spark, sf_dir):
    raw = carrier(spark, sf_dir, "sg_raw")
    return raw.transform(classify.classify_outpatient, CFG).select("rec_id", "sg_confirmado")


@query()
def classify_hospital(spark, sf_dir):
    raw = carrier(spark, sf_dir, "srag_raw")
    return raw.transform(classify.classify_hospital, CFG).select(
        "rec_id", "tipo_teste", "srag_dt_coleta", "srag_confirmado"
    )


@query()
def keyword_flags(spark, sf_dir):
    raw = carrier(spark, sf_dir, "sg_raw")
    flags = list(C.CONDITION_KEYWORDS)
    return raw.transform(classify.keyword_flags).select("rec_id", "sg_condicoes", "assintomatico", *flags)


# --- persons ----------------------------------------------------------------------------------


@query()
def person_comorbidities(spark, sf_dir):
    return _notifications(spark, sf_dir).transform(persons.person_comorbidities)


@query()
def first_known_value(spark, sf_dir):
    return _notifications(spark, sf_dir).transform(persons.first_known_value)


@query()
def person_features(spark, sf_dir):
    return _notifications(spark, sf_dir).transform(persons.person_features)


@query()
def flags_fill_zero(spark, sf_dir):
    return (
        _notifications(spark, sf_dir)
        .transform(persons.person_features)
        .transform(persons.flags_fill_zero)
        .select("rec_id", "sistema", *C.FLAGS)
    )


@query()
def first_positive(spark, sf_dir):
    tests = _lab(spark, sf_dir).transform(records.study_window, CFG)
    return tests.transform(persons.attach_first_positive).select("rec_id", "id_vigvac", "firstcasedate")


# --- record rules -----------------------------------------------------------------------------

RULE_COLUMNS = ["rec_id", "id_vigvac", "dt_coleta", "confirmado"]


@query()
def impute_dates(spark, sf_dir):
    return (
        _lab(spark, sf_dir)
        .transform(records.impute_dates)
        .select("rec_id", "dt_coleta", "dt_inicio_sintomas")
    )


@query()
def study_window(spark, sf_dir):
    return (
        _lab(spark, sf_dir)
        .transform(records.study_window, CFG)
        .select(*RULE_COLUMNS, "dt_inicio_sintomas", "idade")
    )


@query()
def date_consistency(spark, sf_dir):
    return (
        _lab(spark, sf_dir)
        .transform(records.impute_dates)
        .transform(records.date_consistency, CFG)
        .select("rec_id", "dt_coleta", "dt_inicio_sintomas")
    )


@query()
def complete_case(spark, sf_dir):
    return (
        _lab(spark, sf_dir)
        .transform(records.complete_case)
        .transform(records.label_records)
        .transform(records.valid_categories, CFG)
        .select("rec_id", "cod_ibge", "uf", "sexo", "raca", "idade", "dt_coleta")
    )


@query()
def dedup_first(spark, sf_dir):
    return (
        _lab(spark, sf_dir)
        .transform(records.study_window, CFG)
        .transform(records.onset_floor, CFG)
        .transform(persons.dedup_tests)
        .select(*RULE_COLUMNS)
    )


@query()
def neg_then_pos(spark, sf_dir):
    return _lab(spark, sf_dir).transform(P.without_false_negatives, CFG).select(*RULE_COLUMNS, "firstcasedate")


@query()
def days_diff_test(spark, sf_dir):
    return _lab(spark, sf_dir).transform(P.with_gaps, CFG).select(*RULE_COLUMNS, "days_diff_test", "seq_no")


@query()
def fill_down(spark, sf_dir):
    return (
        _lab(spark, sf_dir)
        .transform(P.with_gaps, CFG)
        .transform(W.fill_down)
        .select("rec_id", "dt_interna_dt", "evolucao", "dt_evoluca")
    )


@query()
def same_result_gap(spark, sf_dir):
    return _lab(spark, sf_dir).transform(P.spaced_same_result, CFG).select(*RULE_COLUMNS)


@query()
def mixed_result_gap(spark, sf_dir):
    return _lab(spark, sf_dir).transform(P.spaced_tests, CFG).select(*RULE_COLUMNS)


@query()
def outcome_events(spark, sf_dir):
    return (
        _lab(spark, sf_dir)
        .transform(P.linked_outcomes, CFG)
        .select("rec_id", "diff_sample_hosp", "diff_sample_death", "hosp_event", "death_event",
                "death_event_sensi", "outcome", "days_diff_test")
    )


@query()
def severe_negative_gap(spark, sf_dir):
    return _lab(spark, sf_dir).transform(P.clean_tests, CFG).select(*RULE_COLUMNS, "outcome", "uf", "raca")


# --- exposure ---------------------------------------------------------------------------------


@query()
def vaccine_consistency(spark, sf_dir):
    vacc = _vacc(spark, sf_dir).transform(exposure.vaccinated_persons)
    return vacc.select(
        "id_vigvac",
        exposure.inconsistency_flag(CFG).alias("flag_incon"),
        exposure.inconsistency_flag(CFG, check_age=True).alias("flag_incon_age"),
    )


@query()
def join_vaccination(spark, sf_dir):
    tests = _lab(spark, sf_dir).transform(P.clean_tests, CFG)
    coded = _vacc(spark, sf_dir).transform(exposure.coded_vaccination, CFG)
    return tests.transform(exposure.join_vaccination, coded).select(
        "rec_id", "id_vigvac", "flag_incon", "d_idade", *exposure.DOSES
    )


@query()
def recode_labels(spark, sf_dir):
    names = [f"d{k}_nome_vacina" for k in (1, 2, 3)]
    return (
        _vacc(spark, sf_dir)
        .transform(exposure.vaccinated_persons)
        .transform(exposure.recode_products)
        .select("id_vigvac", *names)
    )


@query()
def days_since_dose(spark, sf_dir):
    days = [f"days_vacc_{k}_test" for k in (1, 2, 3)]
    return _linked(spark, sf_dir).transform(exposure.days_since_dose).select("rec_id", *days)


@query()
def vacc_status(spark, sf_dir):
    return (
        _linked(spark, sf_dir)
        .transform(exposure.days_since_dose)
        .transform(exposure.vacc_status)
        .select("rec_id", "vacc_status")
    )


@query()
def vs_type(spark, sf_dir):
    return (
        _linked(spark, sf_dir)
        .transform(exposure.exposure)
        .select("rec_id", "vs_type", "vacc_3_type", "vs_type2")
    )


@query()
def product_groups(spark, sf_dir):
    return (
        _analysis(spark, sf_dir)
        .transform(exposure.product_groups)
        .select("rec_id", "vs_type3", "vaccinated_unvacc", "cv_other", "cv_time")
    )


@query()
def region_codes(spark, sf_dir):
    return (
        _lab(spark, sf_dir)
        .transform(regions.region_codes, CFG)
        .select("rec_id", "cod_ibge", "uf", "macro_region")
    )


@query()
def age_bands(spark, sf_dir):
    return (
        _lab(spark, sf_dir)
        .transform(cohorts.with_age_groups)
        .select(
            "rec_id",
            "idade_cat",
            "idade_10",
            age_band("idade", C.UPTAKE_BANDS).alias("faixa_etaria"),
            age_band("idade", C.UPTAKE_BANDS_60).alias("faixa_60"),
        )
    )


# --- analysis table ---------------------------------------------------------------------------


@query()
def analysis_table(spark, sf_dir):
    """The analysis rows in one lazy plan, comorbidities as a plain count."""
    return _analysis(spark, sf_dir)


@query()
def analysis_table_by_person(spark, sf_dir):
    """The analysis rows from stages bucketed by person, which further runs under other rules read too."""
    tests = P.tests_by_person(_lab(spark, sf_dir), CFG)
    return P.analysis_table(tests, P.doses_by_person(_vacc(spark, sf_dir)), CFG)


@query()
def prepare_cohort(spark, sf_dir):
    return P.prepare_cohort(
        _lab(spark, sf_dir), _vacc(spark, sf_dir), carrier(spark, sf_dir, "mun_region"), CFG
    )


@query()
def analysis_table_revised(spark, sf_dir):
    revised = _analysis(spark, sf_dir).transform(P.revise_follow_up, CFG)
    return revised.select("rec_id", "vacc_status", "vs_type", "vs_type2", "vacc_3_type", "length", "time_2nd_3rd")


@query()
def attrition(spark, sf_dir):
    return ledger.attrition(_lab(spark, sf_dir), _vacc(spark, sf_dir), CFG)


@query()
def cohort_subsets(spark, sf_dir):
    names = list(cohorts.cohort_conditions())
    return _analysis(spark, sf_dir).transform(cohorts.cohort_flags).select("rec_id", *names)


# --- tables -----------------------------------------------------------------------------------


@query()
def freq_with_null(spark, sf_dir):
    return tables.freq_with_null(_lab(spark, sf_dir), ["confirmado", "raca", "evolucao"])


@query()
def exposure_by_outcome(spark, sf_dir):
    return _analysis(spark, sf_dir).transform(tables.exposure_by_outcome)


@query()
def exposure_by_outcome_age(spark, sf_dir):
    return _analysis(spark, sf_dir).transform(tables.exposure_by_outcome, by_age=True)


@query()
def crude_or(spark, sf_dir):
    return _analysis(spark, sf_dir).transform(tables.crude_or)


def _described(rows):
    return (
        rows.transform(tables.baseline_columns)
        .transform(regions.region_codes, CFG)
        .transform(exposure.product_groups)
    )


@query()
def baseline_table(spark, sf_dir):
    rows = P.prepare_rows(_lab(spark, sf_dir), _vacc(spark, sf_dir), CFG)
    return rows.transform(_described).transform(tables.baseline_table)


@query()
def baseline_table_strata(spark, sf_dir):
    rows = _analysis(spark, sf_dir).transform(_described)
    return rows.transform(
        tables.baseline_table,
        categories=["vs_type3"],
        flags=[],
        numbers=[],
        strata=["idade_cat"],
    )


@query()
def baseline_table_boosted(spark, sf_dir):
    """Tests of boosted persons of the two-dose course, described by booster product."""
    rows = _analysis(spark, sf_dir).where(
        (F.col("tipo_teste") == C.PCR) & F.col("vs_type2").contains("CV_v3_")
    )
    return (
        rows.transform(_described)
        .withColumn("vs_type3", exposure.booster_group())
        .transform(
            tables.baseline_table,
            by="vs_type3",
            by_values=exposure.BOOSTER_GROUPS,
            categories=[
                "idade_cat", "sexo", "raca", "tipo_teste", "macro_region", "n_comorb", "prev_infected",
                "hosp_event", "death_event", "outcome", "confirmado",
            ],
            flags=tables.TABLE_FLAGS,
            numbers=["idade", "length"],
        )
    )


@query()
def cv_time_table(spark, sf_dir):
    """Course and time since dose against case status, with overall."""
    rows = _analysis(spark, sf_dir).where(F.col("tipo_teste") == C.PCR).transform(exposure.product_groups)
    return rows.transform(tables.baseline_table, categories=["cv_time"], flags=[], numbers=[])


@query()
def unique_persons(spark, sf_dir):
    return _analysis(spark, sf_dir).transform(tables.unique_persons, "confirmado")


@query()
def lump_levels(spark, sf_dir):
    rows = savepoint(_linked(spark, sf_dir).select("rec_id", "n_comorb"), "comorbidities")
    return L.lump_levels(rows, "n_comorb", keep=2, other="2+")


@query()
def lump_levels_weighted(spark, sf_dir):
    return S.lumped_variants(_variants(spark, sf_dir))


# --- series -----------------------------------------------------------------------------------


@query()
def weekly_histogram(spark, sf_dir):
    rows = _analysis(spark, sf_dir).where(F.col("tipo_teste") == C.PCR).transform(exposure.product_groups)
    return rows.transform(
        S.case_control_histogram, CFG
    )


@query()
def weekly_histogram_all_tests(spark, sf_dir):
    """The case-control histogram over all test types."""
    return _analysis(spark, sf_dir).transform(exposure.product_groups).transform(S.case_control_histogram, CFG)


@query()
def interval_histogram(spark, sf_dir):
    return _analysis(spark, sf_dir).transform(S.interval_histogram)


@query()
def booster_delay_bar(spark, sf_dir):
    return _analysis(spark, sf_dir).transform(S.booster_delay_bar)


@query()
def uptake_daily(spark, sf_dir):
    return _vacc(spark, sf_dir).transform(S.uptake_daily, CFG)


@query(digits=12)
def uptake_cumulative(spark, sf_dir):
    return _vacc(spark, sf_dir).transform(S.uptake_cumulative, CFG)


@query(digits=12)
def booster_mix(spark, sf_dir):
    return _vacc(spark, sf_dir).transform(S.booster_mix, CFG)


@query(digits=12)
def uptake_by_product(spark, sf_dir):
    return _vacc(spark, sf_dir).transform(S.uptake_by_product, CFG)


@query(digits=12)
def uptake_by_product_all(spark, sf_dir):
    return _vacc(spark, sf_dir).transform(S.uptake_by_product_all, CFG)


@query(digits=12)
def uptake_filled(spark, sf_dir):
    return _vacc(spark, sf_dir).transform(S.uptake_filled, CFG)


@query()
def second_dose_missing(spark, sf_dir):
    return _vacc(spark, sf_dir).transform(S.second_dose_missing, CFG)


@query()
def epidemic_series(spark, sf_dir):
    return _lab(spark, sf_dir).transform(S.epidemic_series, CFG)


@query()
def severe_outcomes(spark, sf_dir):
    return _lab(spark, sf_dir).transform(S.severe_outcomes, CFG)


@query()
def severe_series_all_results(spark, sf_dir):
    """Weekly severe outcomes of cases and controls."""
    return _lab(spark, sf_dir).transform(S.severe_series, CFG)


@query()
def axis_months(spark, sf_dir):
    """Cases by month and quarter of onset along the series' axis; months without cases stay."""
    cases = _lab(spark, sf_dir).where((F.col("confirmado") == C.CASE) & F.col("dt_inicio_sintomas").isNotNull())
    return reshape.tagged_union(
        {step: S.monthly_counts(cases, "dt_inicio_sintomas", CFG.axis_start, CFG.axis_end, months) for step, months in (("month", 1), ("quarter", 3))},
        "step",
    )


@query()
def variant_share(spark, sf_dir):
    return _variants(spark, sf_dir).transform(S.variant_share)


# --- effectiveness ----------------------------------------------------------------------------


def _terms(crude):
    """Crude odds ratios in the shape of model terms."""
    return crude.withColumn("term", F.concat(F.lit("vs_type2"), "vs_type2"))


@query()
def ve_terms(spark, sf_dir):
    """Effectiveness from crude odds ratios, the single-factor case of the model."""
    crude = _analysis(spark, sf_dir).transform(tables.crude_or, cohorts=["Infection", "Severe"])
    return models.extract_ve(_terms(crude).select("cohort", "term", "estimate", "std_error"))


@query()
def ve_figure_frame(spark, sf_dir):
    """Crude results of two outcomes, overall and by age, in the figure's shape."""
    rows = savepoint(_analysis(spark, sf_dir).transform(tables.exposure_counts), "exposure_counts")

    def sheet(outcome, name):
        by_age = not isinstance(name, str)
        counts = tables.crude_or_of_counts(rows, by_age=by_age, cohorts=[outcome])
        return counts.transform(tables.reported_exposures).select(
            (name if by_age else F.lit(name)).alias("id"),
            F.concat(F.lit("vs_type2"), "vs_type2").alias("term"),
            (1 - F.round("odds_ratio", 3)).alias("VE"),
            (1 - F.round("or_upper", 3)).alias("Lower"),
            (1 - F.round("or_lower", 3)).alias("Upper"),
        )

    def workbook(outcome):
        return reshape.stack_frames(
            sheet(outcome, "Overall"),
            sheet(outcome, F.col("idade_cat")),
            sheet(f"{outcome}_antigen", "sensibilidade"),
        )

    return models.ve_figure_frame({"1": workbook("Infection"), "2": workbook("Severe")})


@query()
def ve_model(spark, sf_dir):
    return models.ve_model(_patterns(spark, sf_dir), cohort="Infection")


@query()
def ve_confounder_ladder(spark, sf_dir):
    return models.confounder_ladder(_patterns(spark, sf_dir))


@query()
def ve_by_outcome(spark, sf_dir):
    return models.by_outcome(_patterns(spark, sf_dir))


@query()
def ve_by_age(spark, sf_dir):
    return models.by_age(_patterns(spark, sf_dir))


@query()
def ve_reference_change(spark, sf_dir):
    return models.reference_change(_patterns(spark, sf_dir))


@query()
def ve_single_factor(spark, sf_dir):
    """Fits with exposure alone, one per cohort."""
    return models.single_factor(_patterns(spark, sf_dir))


@query()
def ve_single_factor_age(spark, sf_dir):
    """Fits with exposure alone, one per cohort and age group."""
    return models.single_factor(_patterns(spark, sf_dir), by_age_group=True)


@query()
def ve_antigen(spark, sf_dir):
    return models.by_outcome(_patterns(spark, sf_dir), ["Infection_antigen", "Severe_antigen"])


@query()
def ve_bias_reduced(spark, sf_dir):
    """Exposure alone under Jeffreys' prior, which has an estimate also for levels without cases."""
    return models.single_factor(_patterns(spark, sf_dir), bias_reduced=True)


@query()
def ve_bias_reduced_age(spark, sf_dir):
    return models.single_factor(_patterns(spark, sf_dir), by_age_group=True, bias_reduced=True)


@query()
def ve_by_outcome_bias_reduced(spark, sf_dir):
    """Adjusted effectiveness per cohort under Jeffreys' prior."""
    return models.effects(_patterns(spark, sf_dir), models.outcome_specs(), bias_reduced=True)


# Score equations of the adjusted fits: fitted against observed cases by level.


@query(digits=4)
def ve_model_scores(spark, sf_dir):
    return models.scores(_patterns(spark, sf_dir), [models.main_spec("Infection")])


@query(digits=4)
def ve_confounder_ladder_scores(spark, sf_dir):
    return models.scores(_patterns(spark, sf_dir), models.ladder_specs())


@query(digits=4)
def ve_by_outcome_scores(spark, sf_dir):
    return models.scores(_patterns(spark, sf_dir), models.outcome_specs())


@query(digits=4)
def ve_by_age_scores(spark, sf_dir):
    return models.scores(_patterns(spark, sf_dir), models.age_specs())


@query(digits=4)
def ve_reference_change_scores(spark, sf_dir):
    return models.scores(_patterns(spark, sf_dir), models.reference_specs())


@query(digits=4)
def ve_antigen_scores(spark, sf_dir):
    return models.scores(_patterns(spark, sf_dir), models.outcome_specs(models.effectiveness.ANTIGEN))


@query(digits=4)
def ve_by_outcome_bias_reduced_scores(spark, sf_dir):
    return models.scores(_patterns(spark, sf_dir), models.outcome_specs(), bias_reduced=True)
