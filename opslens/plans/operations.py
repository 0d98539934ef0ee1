"""The operations pipeline over the operational tables, from raw extracts to published results.

    python -m opslens.plans.operations --raw RAW_FOLDER --out OUT_FOLDER

Each function below takes and returns frames; ``run`` strings them together and writes every stage, so that a
later stage reads a table and not the whole plan before it. ``publish`` makes a run visible when it has ended well.
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions.scalar import half_up, ratio
from opslens.operators import cleaning, distributions, features, kpis, measures, model, quality, trends
from opslens.operators.observed import observed_write
from opslens.operators.rollups import Hop
from opslens.operators.sampling import stratified_split
from opslens.session import build_session, input_size, run_folder, shuffle_partitions_for, spread, stored
from opslens.sources import tables as io
from opslens.sources.publish import Published
from opslens.sources.schemas import NATURAL_KEY

Frames = Mapping[str, DataFrame]

# Capacity window and metrics of the published results.
WINDOW_DAYS = 1096
CLIPPED = ["length_of_stay_days", "severity_score"]
ADMISSION_TYPES = ["Emergency", "Urgent", "Elective", "Newborn", "Trauma"]
EMPLOYMENT = ["Full-Time", "Part-Time", "Contract"]
RESULTS = ["raw", "quality", "profile", "tables", "cleaned", "query_results", "dashboard_data", "charts", "measures"]
KPI_METRICS = [
    "total_admissions", "avg_los_days", "readmission_rate_pct", "avg_wait_minutes", "avg_discharge_efficiency",
    "avg_satisfaction", "gross_billings",
]
CORRELATED = [
    "severity_score", "length_of_stay_days", "wait_minutes", "discharge_efficiency", "patient_age", "treatment_count",
    "gross_charge", "margin", "satisfaction_score", "readmitted_30d",
]


# --- raw data ---------------------------------------------------------------------------------------------


def quality_checks(raw: Frames) -> dict[str, DataFrame]:
    """The five checks of the raw load."""
    stays = raw["admissions"]
    return {
        "duplicate_admissions": quality.duplicate_keys(stays, NATURAL_KEY),
        "non_positive_waits": quality.non_positive_rows(stays, "wait_minutes", ["admission_id", "wait_minutes"]),
        "department_variants": quality.label_variants(stays, "department_raw_text"),
        "missing_intake": quality.missing_fields(raw["patients"], ["insurance_type", "state"], "total_patients"),
        "orphan_billing": quality.orphan_rows(
            raw["billing"].select("billing_id", "admission_id"), "admission_id", stays, "admission_id"
        ).select("billing_id"),
    }


def profile(raw: Frames) -> dict[str, DataFrame]:
    """Schema, missing values, duplicates, distributions of the raw load."""
    stays = raw["admissions"]
    numbers = ["severity_score", "length_of_stay_days", "wait_minutes", "discharge_efficiency"]
    return {
        "admissions_schema": quality.schema_info(stays),
        "admissions_missing": quality.null_counts(stays, only_missing=True),
        "patients_missing": quality.null_counts(raw["patients"]),
        "duplicate_members": quality.preview(
            quality.duplicate_members(stays, NATURAL_KEY), ["patient_id", "admission_date", "admission_id"], 6
        ),
        "duplicates_removed": quality.surplus_rows(stays, NATURAL_KEY),
        "bad_waits": quality.bad_share(stays, F.col("wait_minutes") <= 0),
        "numeric_summary": quality.describe(stays, numbers),
        "raw_department_counts": quality.value_counts(stays, "department_raw_text"),
    }


def clean(raw: Frames) -> tuple[DataFrame, DataFrame]:
    """Cleaned stays and the naming audit. Medians and fences come from the de-duplicated rows."""
    stays = raw["admissions"]
    order = ["admission_id", *[c for c in stays.columns if c not in ("admission_id", *NATURAL_KEY)]]
    # Medians, fences and the result all come from the unique rows, so these are written once.
    unique = stored(cleaning.dedupe_first(stays, NATURAL_KEY, order))
    timed = cleaning.impute_group_median(unique, "department_id", "wait_minutes")
    named = cleaning.canonical_label(timed, "department_id", raw["departments"], "department")
    slim, audit = cleaning.split_audit(named, "department_raw_text", ["admission_id", "department_id", "department"])
    return cleaning.iqr_clip(slim, CLIPPED), audit


def clean_tests() -> dict[str, Column]:
    """What must hold in every row after cleaning."""
    return {
        "wait_minutes is positive": F.coalesce(F.col("wait_minutes") > 0, F.lit(False)),
        "every stay has a department": F.col("department").isNotNull(),
    }


def clean_rules(stays: DataFrame) -> DataFrame:
    """What must hold after cleaning."""
    return quality.all_rules(
        quality.unique_rule(stays, ["admission_id"], "admission_id is unique"), quality.row_rules(stays, clean_tests())
    )


# --- questions over the cleaned tables ----------------------------------------------------------------------


def _department_hops(t: Frames) -> list[Hop]:
    return [
        Hop("admission_id", t["admissions"], "admission_id", ["department_id"]),
        Hop("department_id", t["departments"], "department_id", ["department"]),
    ]


def _direct_hop(t: Frames, *extra: str) -> list[Hop]:
    return [Hop("department_id", t["departments"], "department_id", ["department", *extra])]


def kpi_row(t: Frames) -> DataFrame:
    return kpis.scorecard(
        t["admissions"], t["satisfaction_surveys"], t["billing"],
        stay="length_of_stay_days", flag="readmitted_30d", wait="wait_minutes", efficiency="discharge_efficiency",
        score="satisfaction_score", gross="gross_charge",
    )


def business_queries(t: Frames) -> dict[str, DataFrame]:
    """The ten business questions; where two readings exist, the second carries a suffix."""
    stays = t["admissions"]
    names = stays.drop("department").join(t["departments"].select("department_id", "department"), "department_id")
    outliers = stored(  # the rows and their summary both read it
        kpis.group_outliers(names, "department", "wait_minutes", ["admission_id", "department", "wait_minutes"])
    )
    gross, cost = F.col("gross_charge"), F.col("direct_operating_cost")
    survey_columns = ("admission_id", "satisfaction_score", "wait_minutes")
    return {  # Fixed values: the published names of the results.
        "Q1_executive_kpis": kpi_row(t),
        "Q2_monthly_trend": trends.last_rows(
            trends.monthly_trend(stays, "admission_date", min_periods=3), "admission_month", 6
        ),
        "Q2_monthly_trend_partial": trends.monthly_trend(stays, "admission_date", min_periods=1),
        "Q3_wait_outliers": outliers.orderBy(F.desc("z_score"), "admission_id"),
        "Q3_wait_outlier_summary": kpis.outlier_summary(outliers, "department"),
        "Q4_bed_utilization": kpis.occupancy(
            stays.drop("department"), _direct_hop(t, "staffed_beds"), "department", "staffed_beds",
            F.col("length_of_stay_days"), WINDOW_DAYS,
        ),
        "Q5_readmission_by_efficiency": kpis.rate_by_cut(stays, "discharge_efficiency", "readmitted_30d"),
        "Q5_readmission_by_width_bucket": kpis.rate_by_width_bucket(stays, "discharge_efficiency", "readmitted_30d"),
        "Q6_weekend_vs_weekday_wait": kpis.wait_by_day_type(stays, "admission_date", "wait_minutes"),
        "Q7_financial_margin_by_dept": kpis.margin_by_group(
            t["billing"], _department_hops(t), "department", gross, cost
        ),
        "Q8_treatment_cost_drivers": kpis.cost_by_type(t["treatments"], [], "procedure", F.col("treatment_cost")),
        "Q9_satisfaction_by_wait_band": kpis.score_by_wait_cut(t["satisfaction_surveys"], stays, *survey_columns),
        "Q9_satisfaction_by_wait_case": kpis.score_by_wait_case(t["satisfaction_surveys"], stays, *survey_columns),
        "Q10_physician_panel_load": kpis.load_by_status(
            t["doctors"], stays, "doctor_id", "doctor_id", "employment_status"
        ),
    }


def dashboard_datasets(t: Frames) -> dict[str, DataFrame]:
    """The datasets behind the dashboard."""
    stays = t["admissions"].drop("department")
    gross, cost = F.col("gross_charge"), F.col("direct_operating_cost")
    return {
        "kpi": kpi_row(t),
        "monthly_trend": trends.month_labels(stays, "admission_date"),
        "by_department": kpis.group_table(
            stays, _direct_hop(t), "department", F.col("length_of_stay_days"), F.col("readmitted_30d")
        ),
        "financials_by_department": kpis.financials(t["billing"], _department_hops(t), "department", gross, cost),
        "by_admission_type": kpis.count_with_share(stays, "admission_type"),
        "by_insurance": kpis.mix_with_unknown(t["patients"], "insurance_type"),
    }


def feature_table(t: Frames) -> DataFrame:
    return features.feature_table(
        t["admissions"], t["patients"], t["treatments"], t["billing"], t["satisfaction_surveys"]
    )


def chart_tables(table: DataFrame) -> dict[str, DataFrame]:
    """Tables behind the charts and the quantified findings, from the feature table."""
    bucket, flag = "discharge_efficiency_bucket", "readmitted_30d"
    return {
        "monthly_admissions": trends.gap_filled_months(table, "admission_date"),
        "los_by_department": distributions.box_summary(table, "department", "length_of_stay_days"),
        "readmission_by_discharge_efficiency": distributions.rate_by_bucket(
            table, "discharge_efficiency", flag, features.EFFICIENCY_EDGES, features.EFFICIENCY_LABELS
        ),
        "satisfaction_by_wait_band": distributions.band_means_of(table, "satisfaction_score", "wait_minutes"),
        "admission_type_mix": distributions.mix_table(table, "department", "admission_type", sorted(ADMISSION_TYPES)),
        "admission_type_mix_long": distributions.mix_long(table, "department", "admission_type"),
        "correlations": distributions.correlations(table, CORRELATED),
        "relative_risk": kpis.relative_risk(table, bucket, flag, measures.RUSHED, measures.EXCELLENT),
        "weekend_gap": kpis.gap_pct(table, F.col("is_weekend_admission"), "wait_minutes"),
        "response_rate": features.response_rate(table, "satisfaction_score"),
    }


def dashboard_measures(table: DataFrame, billing: DataFrame, by: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """All measures, for everything or per slicer column.

    Without a slicer the billing measures add up the billing table itself, also bills of unknown stays.
    """
    names = list(measures.definitions())
    values = measures.measures(table, names, by)
    if not by:
        gross, margin = F.sum("gross_charge"), F.sum("gross_charge") - F.sum("direct_operating_cost")
        for name, value in (
            ("gross_billings", gross), ("gross_margin", margin), ("margin_fraction", ratio(margin, gross))
        ):
            values = values.withColumn(name, billing.agg(half_up(value, 6).alias("v")).scalar())
    return {
        "measures": values,
        "mom_change": trends.calendar_shift_change(table, "admission_date"),
        "moving_avg_3m": trends.trailing_daily_mean(table, "admission_date"),
        "calendar": trends.calendar_table(table, "admission_date"),
    }


# --- validation -------------------------------------------------------------------------------------------


def integrity_rules(t: Frames) -> DataFrame:
    """Row rules, declared constraints and foreign keys of the cleaned tables."""
    stays = t["admissions"]
    links = [
        ("admissions", "patient_id", "patients"), ("admissions", "doctor_id", "doctors"),
        ("admissions", "department_id", "departments"), ("doctors", "department_id", "departments"),
        ("billing", "admission_id", "admissions"), ("satisfaction_surveys", "admission_id", "admissions"),
        ("treatments", "admission_id", "admissions"),
    ]
    checks = {
        "departments": {"staffed_beds is positive": F.col("staffed_beds") > 0},
        "doctors": {
            "employment_status is known": F.col("employment_status").isin(*EMPLOYMENT),
            "years_experience is not negative": F.col("years_experience") >= 0,
        },
        "admissions": {
            "admission_date is given": F.col("admission_date").isNotNull(),
            "admission_type is known": F.col("admission_type").isin(*ADMISSION_TYPES),
            "severity_score between 1 and 10": F.col("severity_score").between(1, 10),
            "readmitted_30d is 0 or 1": F.col("readmitted_30d").isin(0, 1),
        },
        "satisfaction_surveys": {"satisfaction_score between 0 and 100": F.col("satisfaction_score").between(0, 100)},
        "treatments": {"procedure is given": F.col("procedure").isNotNull()},
    }
    return quality.all_rules(
        quality.unique_rule(stays, ["admission_id"], "admission_id is unique"),
        quality.unique_rule(stays, NATURAL_KEY, "natural key is unique"),
        quality.row_rules(
            stays,
            {
                "wait_minutes is positive": F.col("wait_minutes") > 0,
                "discharge follows admission": F.col("discharge_date") >= F.col("admission_date"),
            },
            domains={"readmission target is 0 or 1": ("readmitted_30d", [0, 1])},
        ),
        *[quality.row_rules(t[name], rules, null_passes=True) for name, rules in checks.items()],
        *[
            quality.foreign_key_rule(t[child], key, t[parent], key, f"{child}.{key} -> {parent}.{key}")
            for child, key, parent in links
        ],
    )


def reconciliation_rules(table: DataFrame, copy: DataFrame, report: DataFrame, dashboard: DataFrame) -> DataFrame:
    """The two stored copies of the stays hold the same keys, and both publications the same figures."""
    keys = quality.reconcile_keys(table, copy, "admission_id")
    figures = quality.reconcile_metrics(report, dashboard, KPI_METRICS)
    return quality.all_rules(
        quality.rule_result(keys, "both copies hold the same stays", F.count_if(~F.col("matches"))),
        figures.select(
            F.concat(F.lit("one published value of "), "metric").alias("rule"),
            F.when(F.col("agrees"), 0).otherwise(1).cast("long").alias("violations"),
            F.col("agrees").alias("passed"),
        ),
    )


# --- risk model -------------------------------------------------------------------------------------------


def risk_model(table: DataFrame, **params: int) -> dict[str, DataFrame]:
    """Train on an exact 80% of each class, evaluate on the rest."""
    label = "readmitted_30d"
    split = spread(stratified_split(table, label, ["admission_id"]))
    inputs = [model.CATEGORICAL, model.NUMERIC, label]
    train = model.model_frame(split.where(F.col("split") == "train"), *inputs)
    test = model.model_frame(split.where(F.col("split") == "test"), *inputs)
    fitted = model.train_forest(train, *inputs, **params)
    scored = spread(model.score(fitted, test).select(label, "score", "predicted"))
    return {
        "class_shares": quality.value_shares(table, label),
        "auc": model.roc_auc(scored, label, "score"),
        "report": model.classification_report(scored, label, "predicted"),
        "roc": model.roc_points(scored, label, "score"),
        "importances": model.importances(fitted, train, top=15),
    }


# --- the whole run ----------------------------------------------------------------------------------------


def run(spark: SparkSession, raw_folder: str, out: str, with_model: bool = True, **params: int) -> None:
    """All stages; any broken rule ends the run."""
    raw = {}
    for name, frame in io.read_raw(spark, raw_folder).items():  # text is parsed once; the rest scans by column
        io.write_table(frame, f"{out}/raw/{name}")
        raw[name] = io.read_table(spark, f"{out}/raw/{name}")
    io.write_results(quality_checks(raw), f"{out}/quality")
    io.write_results(profile(raw), f"{out}/profile")

    stays, audit = clean(raw)
    # the rows are judged as they are written; only the key's uniqueness needs the table afterwards
    judged = observed_write(stays, clean_tests(), lambda rows: io.write_table(rows, f"{out}/tables/admissions"))
    io.write_csv(audit, f"{out}/cleaned/department_naming_audit")
    t = {**raw, "admissions": io.read_table(spark, f"{out}/tables/admissions")}
    quality.require(judged.unionByName(quality.unique_rule(t["admissions"], ["admission_id"], "admission_id is unique")))
    io.write_csv(t["admissions"], f"{out}/cleaned/admissions_cleaned")

    io.write_results(business_queries(t), f"{out}/query_results")
    io.write_results(dashboard_datasets(t), f"{out}/dashboard_data")

    io.write_table(feature_table(t), f"{out}/tables/admissions_features")
    table = io.read_table(spark, f"{out}/tables/admissions_features")
    io.write_csv(table, f"{out}/cleaned/admissions_features")
    io.write_results(chart_tables(table), f"{out}/charts")
    io.write_results(dashboard_measures(table, t["billing"]), f"{out}/measures")
    if with_model:
        io.write_results(risk_model(table, **params), f"{out}/model")

    copy = io.read_csv(spark, f"{out}/cleaned/admissions_cleaned", t["admissions"].schema)
    published = [
        io.read_result(spark, out, path) for path in ("query_results/Q1_executive_kpis", "dashboard_data/kpi")
    ]
    rules = quality.all_rules(integrity_rules(t), reconciliation_rules(t["admissions"], copy, *published))
    io.write_table(rules, f"{out}/tables/validation")
    quality.require(io.read_table(spark, f"{out}/tables/validation"))


def publish(spark: SparkSession, raw_folder: str, out: str, with_model: bool = True, **params: int) -> Published:
    """A whole run as a new version of the results in ``out``. A run that fails leaves the version before it in place."""
    results = Published(spark, out)
    with results.write() as version:
        run(spark, raw_folder, version.folder, with_model, **params)
        version.add(*RESULTS, *["model"] * with_model)
    return results


def main() -> None:
    parser = argparse.ArgumentParser(description="Run the operations pipeline over a folder of raw CSV tables.")
    parser.add_argument("--raw", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--skip-model", action="store_true")
    parser.add_argument("--input-bytes", type=int, help="size of the raw data, to size the shuffles by")
    options = parser.parse_args()
    spark = build_session("operations pipeline", input_bytes=options.input_bytes)
    if not options.input_bytes:
        size = sum(input_size(frame) for frame in io.read_raw(spark, options.raw).values())
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions_for(size)))
    with run_folder(spark):
        publish(spark, options.raw, options.out, with_model=not options.skip_model)


if __name__ == "__main__":
    main()
