"""The operators give the published figures back when fed with the published totals."""

import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from opslens.operators import distributions, features, kpis, measures, trends
from opslens.operators.rollups import Hop

# Published monthly volumes, January 2023 to December 2025.
MONTHLY = [
    1692, 1439, 1234, 1171, 1222, 1242, 1069, 1049, 1199, 1234, 1248, 1744,
    1734, 1330, 1270, 1202, 1269, 1172, 1070, 1073, 1229, 1187, 1239, 1698,
    1724, 1396, 1251, 1261, 1265, 1210, 1088, 1110, 1199, 1257, 1195, 1528,
]
# Fixed values: (change, 3-month mean) of the last six months.
LAST_SIX = [(-122, 1187.7), (22, 1136.0), (89, 1132.3), (58, 1188.7), (-62, 1217.0), (333, 1326.7)]
# Name, beds, stay days, occupancy in percent.
OCCUPANCY = [
    ("Oncology", 28, 30953.5, 100.9), ("ICU", 20, 21687.5, 98.9), ("Cardiology", 42, 27835.7, 60.5),
    ("Obstetrics", 26, 16988.2, 59.6), ("General Surgery", 38, 24702.2, 59.3), ("Emergency", 60, 38930.2, 59.2),
]
# A score inside the bin, bin, stays, readmitted, rate in percent.
BINS = [
    (15.0, "0-20", 56, 20, 35.71), (40.0, "20-40", 1540, 422, 27.4), (60.0, "40-60", 11805, 2154, 18.25),
    (80.0, "60-80", 22045, 2711, 12.3), (100.0, "80-100", 11054, 854, 7.73),
]
# Department, billings, cost, margin, margin in percent.
MARGINS = [
    ("Emergency", 86760251, 47734566, 39025685.0, 45.0), ("Cardiology", 61227033, 33643461, 27583572.0, 45.1),
    ("Orthopedics", 50226758, 27697125, 22529634.0, 44.9),
]
# Status, doctors, stays, stays per doctor.
LOAD = [("Contract", 16, 5340, 333.8), ("Part-Time", 25, 8304, 332.2), ("Full-Time", 99, 32856, 331.9)]


def repeated(df, n: str):
    """Each row ``n`` times, with a running number ``i`` from 1."""
    return df.select("*", F.explode(F.sequence(F.lit(1), F.col(n))).alias("i"))


@pytest.fixture(scope="module")
def stays_by_month(spark):
    months = [(dt.date(2023 + k // 12, k % 12 + 1, 1), n) for k, n in enumerate(MONTHLY)]
    df = repeated(spark.createDataFrame(months, "first date, n int"), "n")
    return df.select(F.date_add("first", F.col("i") % 28).cast("timestamp_ntz").alias("day"))


def test_monthly_trend(stays_by_month):
    trend = trends.monthly_trend(stays_by_month, "day", min_periods=3)
    assert [tuple(r)[2:] for r in rows(trends.last_rows(trend, "admission_month", 6))] == LAST_SIX
    assert [r[1] for r in rows(trends.month_labels(stays_by_month, "day"))] == MONTHLY
    assert [r[3] for r in rows(trends.calendar_shift_change(stays_by_month, "day"))][-6:] == [c for c, _ in LAST_SIX]


def test_occupancy(frame):
    days = frame("department string, days double", [(d[0], d[2]) for d in OCCUPANCY])
    beds = frame("department string, staffed_beds int", [d[:2] for d in OCCUPANCY])
    hops = [Hop("department", beds, "department", ["staffed_beds"])]
    got = kpis.occupancy(days, hops, "department", "staffed_beds", F.col("days"))
    assert rows(got) == OCCUPANCY


@pytest.fixture(scope="module")
def scored_stays(spark):
    df = repeated(spark.createDataFrame([b[:4] for b in BINS], "score double, bin string, n int, hits int"), "n")
    return df.select("score", (F.col("i") <= F.col("hits")).cast("int").alias("flag"))


def test_rates_and_relative_risk(scored_stays):
    assert rows(kpis.rate_by_cut(scored_stays, "score", "flag")) == [(b[1], b[2], b[4]) for b in BINS]
    bucketed = features.add_bucket(scored_stays, "score")
    risk = kpis.relative_risk(bucketed, "discharge_efficiency_bucket", "flag", measures.RUSHED, measures.EXCELLENT)
    assert rows(risk) == [(27.7, 7.7, 3.58)]
    charts = distributions.rate_by_bucket(
        scored_stays, "score", "flag", features.EFFICIENCY_EDGES, features.EFFICIENCY_LABELS
    )
    assert [round(r[1], 2) for r in rows(charts)] == [27.69, 18.25, 12.3, 7.73]
    total = scored_stays.agg(F.count("flag"), F.round(100 * F.avg("flag"), 2)).first()
    assert tuple(total) == (46500, 13.25)


def test_margins(frame):
    bills = frame("department string, gross long, cost long", [m[:3] for m in MARGINS])
    got = kpis.margin_by_group(bills, [], "department", F.col("gross"), F.col("cost"))
    assert [(r[0], r[4]) for r in rows(got)] == [(m[0], m[4]) for m in MARGINS]
    assert [r[3] for r in rows(got)] == pytest.approx([m[3] for m in MARGINS], abs=1)  # published after rounding


def test_load(spark):
    groups = repeated(spark.createDataFrame([s[:3] for s in LOAD], "status string, doctors int, stays int"), "stays")
    stays = groups.select(F.concat("status", F.lit(" "), (F.col("i") % F.col("doctors")).cast("string")).alias("doctor"), "status")
    doctors = stays.select("doctor", "status").distinct()
    assert rows(kpis.load_by_status(doctors, stays, "doctor", "doctor", "status")) == LOAD
