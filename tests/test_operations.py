"""The pipeline end to end over small raw CSV tables with a known number of faults."""

import csv
import datetime as dt
import json

import pytest
from helpers import row_set, rows
from pyspark.sql import functions as F

from opslens.operators import quality
from opslens.plans import operations as ops
from opslens.sources import tables as io
from opslens.sources.schemas import NATURAL_KEY, SCHEMAS

STAYS, COPIES = 600, 15
DEPARTMENTS = [(1, "Cardiology", 42), (2, "Emergency", 60), (3, "ICU", 20)]
BAD_WAITS = {7: -5, 100: 0, 333: -12}


def write(folder, name, header, lines):
    with (folder / f"{name}.csv").open("w", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(header)
        writer.writerows(lines)


def raw_tables(folder):
    """Numbers follow simple arithmetic, so that the tests can work the answers out again."""
    start = dt.datetime(2023, 1, 1)
    stays = []
    for i in range(1, STAYS + 1):
        department = i % 3 + 1
        days = (i * 7) % 90 / 10 + 0.5
        admitted = start + dt.timedelta(days=i * 13 % 1000)
        efficiency = (i * 37) % 91 + 9.5
        risky = efficiency < 40 and i % 2 == 0
        raw = {1: ["Cardiology", "CARDIOLOGY", "cardiology"][i % 7 % 3], 2: "ER" if i % 5 == 0 else "Emergency", 3: "ICU"}
        discharged = admitted + dt.timedelta(days=days)
        stays.append([
            i, i % 90 + 1, i % 9 + 1, department, admitted.date().isoformat(), ops.ADMISSION_TYPES[i % 5],
            i % 10 + 1 - (i % 10 == 9) * 0.5, days, discharged.isoformat(sep=" "), float(BAD_WAITS.get(i, i % 70 + 1)),
            efficiency, int(risky), raw[department],
        ])
    names = SCHEMAS["admissions"].fieldNames()
    write(folder, "admissions", names, stays + stays[40 : 40 + COPIES])
    write(folder, "departments", SCHEMAS["departments"].fieldNames(), DEPARTMENTS)
    write(folder, "doctors", SCHEMAS["doctors"].fieldNames(), [[i, f"Doctor {i}", i % 3 + 1, ops.EMPLOYMENT[i % 3], i] for i in range(1, 11)])
    people = [
        [i, f"Person {i}", f"{1930 + i}-03-01", "Female", "" if i % 30 == 0 else "NY", "" if i % 9 == 0 else "Medicare"]
        for i in range(1, 92)
    ]
    write(folder, "patients", SCHEMAS["patients"].fieldNames(), people)
    bills = [[i, i, f"{i * 10}.50", f"{i * 5}.25", f"{i * 5}.25", f"{i * 6}.50"] for i in range(1, STAYS + 1)]
    write(folder, "billing", SCHEMAS["billing"].fieldNames(), bills)
    write(folder, "satisfaction_surveys", SCHEMAS["satisfaction_surveys"].fieldNames(), [[i, i * 2, i % 101, 3] for i in range(1, 301)])
    treatments = [[i, i % 500 + 1, ["X-Ray", "MRI Scan"][i % 2], f"{i % 50}.25"] for i in range(1, 1001)]
    write(folder, "treatments", SCHEMAS["treatments"].fieldNames(), treatments)
    return folder


@pytest.fixture(scope="module")
def raw_folder(tmp_path_factory):
    return str(raw_tables(tmp_path_factory.mktemp("raw")))


@pytest.fixture(scope="module")
def raw(spark, raw_folder):
    return io.read_raw(spark, raw_folder)


@pytest.fixture(scope="module")
def published(spark, raw_folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out") / "run")
    ops.run(spark, raw_folder, out, trees=10, depth=4, min_leaf=5)
    return out


def test_csv_is_read_by_the_declared_schema(raw):
    stays = raw["admissions"]
    assert stays.schema == SCHEMAS["admissions"]
    first = stays.where("admission_id = 1").first()
    assert first["admission_date"] == dt.datetime(2023, 1, 14)
    assert first["discharge_date"] == dt.datetime(2023, 1, 14) + dt.timedelta(days=1.2)


def test_checks_find_the_injected_faults(raw):
    checks = ops.quality_checks(raw)
    assert checks["duplicate_admissions"].count() == COPIES
    assert row_set(checks["non_positive_waits"]) == {(i, float(v)) for i, v in BAD_WAITS.items()}
    assert {r[0] for r in rows(checks["department_variants"])} == {
        "CARDIOLOGY", "Cardiology", "ER", "Emergency", "ICU", "cardiology"
    }
    assert rows(checks["missing_intake"]) == [(10, 3, 91)]
    assert checks["orphan_billing"].count() == 0
    profile = ops.profile(raw)
    assert rows(profile["duplicates_removed"]) == [(STAYS + COPIES, COPIES, 2.44)]
    assert profile["duplicate_members"].count() == 6
    assert rows(profile["bad_waits"]) == [(3, 0.49)]


def test_clean_repairs_every_fault(raw):
    stays, audit = ops.clean(raw)
    assert stays.count() == STAYS and audit.count() == STAYS
    assert rows(ops.clean_rules(stays)) and all(r[2] for r in rows(ops.clean_rules(stays)))
    waits = sorted(i % 70 + 1 for i in range(1, STAYS + 1) if i % 3 + 1 == 2 and i not in BAD_WAITS)
    middle = len(waits) // 2
    median = waits[middle] if len(waits) % 2 else (waits[middle - 1] + waits[middle]) / 2
    assert stays.where("admission_id = 7").first()["wait_minutes"] == median
    assert "department_raw_text" not in stays.columns and "department_raw_text" in audit.columns
    assert ops.clean(raw)[0].repartition(7).exceptAll(stays).isEmpty()


def test_published_results(spark, published):
    def result(name, schema=None):
        return io.read_result(spark, published, name, schema)

    kpi = result("query_results/Q1_executive_kpis").first()
    assert kpi["total_admissions"] == STAYS
    assert kpi["gross_billings"] == round(sum(i * 10 + 0.5 for i in range(1, STAYS + 1)))
    assert result("query_results/Q2_monthly_trend").count() == 6
    assert {r["department"] for r in result("query_results/Q4_bed_utilization").collect()} == {d[1] for d in DEPARTMENTS}
    assert result("query_results/Q10_physician_panel_load").agg(F.sum("total_admissions")).first()[0] == STAYS
    assert result("dashboard_data/by_admission_type").agg(F.sum("admissions")).first()[0] == STAYS
    assert {r["insurance_type"] for r in result("dashboard_data/by_insurance").collect()} == {"Medicare", "Unknown"}
    assert result("charts/correlations").count() == 100
    assert result("measures/measures").first()["total_admissions"] == STAYS
    assert 0.5 < result("model/auc").first()["auc"] <= 1
    assert result("model/report").count() == 5
    rules = io.read_table(spark, f"{published}/tables/validation")
    assert rules.count() > 25 and rules.where("not passed").isEmpty()


def test_feature_table(spark, published):
    table = io.read_table(spark, f"{published}/tables/admissions_features")
    assert len(table.columns) == 23 and table.count() == STAYS
    one = table.where("admission_id = 4").first()
    assert one["treatment_count"] == 2 and float(one["gross_charge"]) == 40.5
    assert float(one["margin"]) == 40.5 - 24.5 and one["satisfaction_score"] == 2.0
    assert table.where("admission_id = 3").first()["satisfaction_score"] is None
    assert table.where("admission_id = 550").first()["treatment_count"] == 0
    again = io.read_csv(spark, f"{published}/cleaned/admissions_features", table.schema)
    assert again.exceptAll(table).isEmpty() and again.count() == STAYS


def test_run_stops_on_a_broken_rule(spark, raw):
    t = {**raw, "billing": raw["billing"].withColumn("admission_id", F.col("admission_id") + 1)}
    broken = ops.integrity_rules(t).where("not passed")
    assert {r["rule"] for r in broken.collect()} == {
        "admission_id is unique", "natural key is unique", "wait_minutes is positive",
        "billing.admission_id -> admissions.admission_id",
    }
    with pytest.raises(AssertionError, match="billing.admission_id"):
        quality.require(broken)


def test_measures_per_slicer(spark, published):
    table = io.read_table(spark, f"{published}/tables/admissions_features")
    billing = io.read_table(spark, f"{published}/raw/billing")
    total = ops.dashboard_measures(table, billing)["measures"].first()
    sliced = ops.dashboard_measures(table, billing, ("department",))["measures"].collect()
    assert sum(r["gross_billings"] for r in sliced) == pytest.approx(total["gross_billings"])
    assert 0 < total["margin_fraction"] < 1


# --- readers and writers ----------------------------------------------------------------------------------


def test_tables_are_not_overwritten(spark, tmp_path):
    path = str(tmp_path / "t")
    io.write_table(spark.range(3), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        io.write_table(spark.range(4), path)
    assert io.read_table(spark, path).count() == 3
    io.write_table(spark.range(4).withColumn("p", F.col("id") % 2), str(tmp_path / "p"), ["p"])
    assert io.read_table(spark, str(tmp_path / "p")).where("p = 1").count() == 2


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stays = io.write_bucketed(spark.range(1000).withColumnRenamed("id", "k"), "stays_b", str(tmp_path / "s"), "k", 4)
        bills = io.write_bucketed(spark.range(500).select(F.col("id").alias("k"), F.lit(2).alias("v")), "bills_b", str(tmp_path / "b"), "k", 4)
        joined = stays.join(bills.groupBy("k").agg(F.sum("v").alias("v")), "k", "left")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.agg(F.count("*"), F.sum("v")).first()[:] == (1000, 1000)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS stays_b")
        spark.sql("DROP TABLE IF EXISTS bills_b")


def test_csv_renames_and_fails_on_malformed_rows(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n1,2024-01-02\n")
    df = io.read_csv(spark, str(path), "a int, b timestamp_ntz", {"b": "moment"})
    assert rows(df) == [(1, dt.datetime(2024, 1, 2))]
    path.write_text("a,b\nnot a number,2024-01-02\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        io.read_csv(spark, str(path), "a int, b timestamp_ntz").collect()


def test_text_moments_are_parsed(frame):
    df = io.parse_moments(frame("a string", [("2024-01-02 03:04:05",)]), ["a"])
    assert rows(df) == [(dt.datetime(2024, 1, 2, 3, 4, 5),)]


def test_json_results_keep_nulls(spark, frame, tmp_path):
    io.write_results({"one": frame("a int, b string", [(1, None)])}, str(tmp_path))
    text = "".join(part.read_text() for part in (tmp_path / "one").glob("*.json"))
    assert json.loads(text) == {"a": 1, "b": None}


def test_json_document(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"kpi": {"a": 1, "b": 2.5}, "trend": [{"m": "2024-01", "n": 3}, {"m": "2024-02", "n": 4}], "n": 5}, indent=1))
    assert rows(io.read_document(spark, str(path), "kpi")) == [(1, 2.5)]
    assert rows(io.read_document(spark, str(path), "trend")) == [("2024-01", 3), ("2024-02", 4)]
    assert rows(io.read_document(spark, str(path), "n")) == [(5,)]


def test_sql_over_frames(spark, frame):
    tables = {"facts_view": frame("k int, v int", [(1, 2), (1, 3)])}
    assert rows(io.read_sql(spark, "SELECT k, sum(v) AS v FROM facts_view GROUP BY k", tables)) == [(1, 5)]


def test_natural_key_is_part_of_the_schema():
    assert set(NATURAL_KEY) <= set(SCHEMAS["admissions"].fieldNames())
