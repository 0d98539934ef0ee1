import datetime as dt
from decimal import Decimal as D

import pytest
from helpers import row_set, rows
from pyspark.sql import functions as F

from opslens.operators import distributions, features, kpis, measures, trends
from opslens.operators.rollups import Hop


def test_scorecard_with_unknown_flags(frame):
    stays = frame("d double, f int, w double, e double", [(2.0, 1, 10.0, 50.0), (3.0, None, None, 70.0)])
    surveys, bills = frame("s double", [(80.0,), (None,)]), frame("g decimal(12,2)", [(None,)])
    got = kpis.scorecard(stays, surveys, bills, stay="d", flag="f", wait="w", efficiency="e", score="s", gross="g")
    assert rows(got) == [(2, 2.5, 50.0, 10.0, 60.0, 80.0, None)]


def test_occupancy_and_margin_guards(frame):
    facts = frame("g int, days double, gross double, cost double", [(1, 5.0, 10.0, 4.0), (1, 5.0, 10.0, 6.0), (2, 1.0, 0.0, 1.0)])
    groups = frame("id int, name string, beds int", [(1, "a", 2), (2, "b", 0), (3, "c", 5)])
    hops = [Hop("g", groups, "id", ["name", "beds"])]
    got = kpis.occupancy(facts, hops, "name", "beds", F.col("days"), window_days=10)
    assert rows(got) == [("a", 2, 10.0, 50.0), ("b", 0, 1.0, None)]
    got = kpis.margin_by_group(facts, hops, "name", F.col("gross"), F.col("cost"))
    assert rows(got) == [("a", 20.0, 10.0, 10.0, 50.0), ("b", 0.0, 1.0, -1.0, None)]


def test_rates_by_bucket_keep_edges(frame):
    df = frame("s double, f int", [(0.0, 1), (20.0, 1), (20.5, 0), (100.0, 1), (101.0, 1), (60.0, None)])
    left = rows(kpis.rate_by_width_bucket(df, "s", "f"))
    assert left == [(1, 1, 100.0), (2, 2, 50.0), (4, 1, None), (6, 2, 100.0)]
    right = rows(kpis.rate_by_cut(df, "s", "f"))
    assert right == [("0-20", 1, 100.0), ("20-40", 1, 0.0), ("40-60", 0, None), ("80-100", 1, 100.0)]


def test_survey_bands(frame):
    stays = frame("id int, w double", [(1, 15.0), (2, 0.0), (3, 45.0), (4, 5.0)])
    surveys = frame("id int, s double", [(1, 80.0), (2, 60.0), (3, None), (9, 1.0)])
    assert rows(kpis.score_by_wait_case(surveys, stays, "id", "s", "w")) == [
        ("<15 min", 60.0, 1), ("15-30 min", 80.0, 1), ("30-60 min", None, 1)
    ]
    assert rows(kpis.score_by_wait_cut(surveys, stays, "id", "s", "w")) == [("<15 min", 70.0, 2), ("30-60 min", None, 0)]
    assert rows(distributions.band_means(surveys, stays, "id", "s", "w")) == [("<15", 80.0, 1)]


def test_load_counts_only_doctors_with_stays(frame):
    doctors = frame("id int, status string", [(1, "x"), (2, "x"), (3, "y"), (4, "y")])
    stays = frame("doc int", [(1,), (1,), (2,), (3,)])
    assert rows(kpis.load_by_status(doctors, stays, "id", "doc", "status")) == [("x", 2, 3, 1.5), ("y", 1, 1, 1.0)]


def test_group_table_marks_rates_above_all(frame):
    facts = frame("g int, d double, f int", [(1, 2.0, 1), (1, 4.0, 1), (2, 1.0, 0), (2, None, 0)])
    hops = [Hop("g", frame("id int, name string", [(1, "a"), (2, "b")]), "id", ["name"])]
    got = rows(kpis.group_table(facts, hops, "name", F.col("d"), F.col("f")))
    assert got == [("a", 2, 3.0, 100.0, True), ("b", 2, 1.0, 0.0, False)]


def test_shares_and_unknown(frame):
    df = frame("k string", [("x",), ("x",), (None,), ("y",)])
    assert rows(kpis.count_with_share(df, "k"))[0] == ("x", 2, 50.0)
    assert rows(kpis.mix_with_unknown(df, "k")) == [("x", 2), ("Unknown", 1), ("y", 1)]


def test_relative_risk_without_baseline_cases(frame):
    df = frame("b string, f int", [("hi", 1), ("hi", 0), ("lo", 0)])
    assert rows(kpis.relative_risk(df, "b", "f", "hi", "lo")) == [(50.0, 0.0, None)]
    assert rows(kpis.relative_risk(df, "b", "f", "lo", "hi")) == [(0.0, 50.0, 0.0)]


def test_outliers_ignore_flat_and_single_groups(frame):
    values = [("a", 1.0)] * 30 + [("a", 100.0), ("flat", 5.0), ("flat", 5.0), ("one", 9.0)]
    out = kpis.group_outliers(frame("g string, v double", values), "g", "v", ["g", "v"])
    assert [r[:2] for r in rows(out)] == [("a", 100.0)]
    assert rows(kpis.outlier_summary(out, "g")) == [(1, "a")]
    tie = frame("g string", [("b",), ("a",), ("b",), ("a",)])
    assert rows(kpis.outlier_summary(tie, "g")) == [(4, "a")]
    assert rows(kpis.outlier_summary(tie.limit(0), "g")) == [(0, None)]


@pytest.fixture
def gappy(frame):
    days = ["2024-01-05", "2024-01-05", "2024-01-20", "2024-03-02", "2024-04-01", "2024-04-02"]
    return frame("d timestamp_ntz", [(dt.datetime.fromisoformat(d),) for d in days] + [(None,)])


def month(n):
    return dt.date(2024, n, 1)


def test_trend_uses_rows_and_calendar_uses_months(gappy):
    partial = rows(trends.monthly_trend(gappy, "d", min_periods=1))
    assert partial == [(month(1), 3, None, 3.0), (month(3), 1, -2, 2.0), (month(4), 2, 1, 2.0)]
    assert [r[3] for r in rows(trends.monthly_trend(gappy, "d", min_periods=3))] == [None, None, 2.0]
    assert rows(trends.gap_filled_months(gappy, "d")) == [(month(1), 3), (month(2), 0), (month(3), 1), (month(4), 2)]
    assert rows(trends.calendar_shift_change(gappy, "d")) == [
        (month(1), 3, None, 3), (month(2), 0, 3, -3), (month(3), 1, 0, 1), (month(4), 2, 1, 1)
    ]


def test_trailing_daily_mean_skips_blank_days(gappy):
    got = rows(trends.trailing_daily_mean(gappy, "d"))
    assert got == [(month(1), 1.5), (month(2), 1.5), (month(3), 1.3333), (month(4), 1.0)]


def test_series_shorter_than_the_window(frame):
    df = frame("d date", [(dt.date(2024, 1, 1),), (dt.date(2024, 2, 1),)])
    assert [r[3] for r in rows(trends.monthly_trend(df, "d", min_periods=3))] == [None, None]
    assert rows(trends.last_rows(trends.monthly_trend(df, "d"), "admission_month", 1))[0][0] == month(2)


def test_calendar(frame):
    df = frame("d date", [(dt.date(2024, 2, 28),), (dt.date(2024, 3, 2),)])
    got = rows(trends.calendar_table(df, "d").orderBy("date"))
    assert [r[0].day for r in got] == [28, 29, 1, 2] and got[-1] == (dt.date(2024, 3, 2), 2024, 3, True)
    assert rows(trends.calendar_table(df.limit(0), "d")) == []
    assert rows(trends.gap_filled_months(df.limit(0), "d")) == []


def test_box_summary(frame):
    df = frame("g string, v double", [("a", float(v)) for v in (1, 2, 3, 4, 5, 100)] + [("b", 7.0), ("b", None)])
    got = rows(distributions.box_summary(df, "g", "v"))
    assert got == [("b", 1, 7.0, 7.0, 7.0, 7.0, 7.0, 0), ("a", 6, 1.0, 2.25, 3.5, 4.75, 5.0, 1)]


def test_mix(frame):
    df = frame("g string, k string", [("a", "x"), ("a", "y"), ("b", "x"), ("b", None), (None, "x")])
    got = distributions.mix_table(df, "g", "k", ["x", "y"])
    assert got.columns == ["g", "x", "y"] and rows(got) == [("a", 50.0, 50.0), ("b", 100.0, 0.0)]
    assert row_set(distributions.mix_long(df, "g", "k")) == {("a", "x", 50.0), ("a", "y", 50.0), ("b", "x", 100.0)}
    many = df.sparkSession.range(1200).selectExpr("'a' AS g", "string(id) AS k")
    assert distributions.mix_long(many, "g", "k").count() == 1200


def test_correlations(frame):
    data = [(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, 1.0), (3.0, 6.0, 5.0, 0.0), (4.0, 9.0, 5.0, None)]
    got = {r[:2]: r[2] for r in rows(distributions.correlations(frame("a double, b double, c double, d double", data), list("abcd")))}
    assert len(got) == 16 and got[("a", "a")] == 1.0 and got[("a", "b")] == got[("b", "a")]
    assert got[("a", "c")] is None and got[("c", "c")] is None  # constant
    assert got[("a", "d")] == -1.0  # over the rows where both are known


def test_feature_steps(frame):
    stays = frame("id int, days double", [(1, 2.0), (2, 0.0), (3, 1.0)])
    children = frame("id int, c int, cost decimal(10,2)", [(1, 1, D(5)), (1, 2, D(7)), (9, 3, D(1))])
    got = features.add_children(stays, children, "id", "c", "cost").orderBy("id")
    assert [(r[0], r[2], float(r[3])) for r in rows(got)] == [(1, 2, 12.0), (2, 0, 0.0), (3, 0, 0.0)]
    bills = frame("id int, g double, c double", [(1, 10.0, 4.0), (2, 3.0, 1.0)])
    got = features.add_finance(stays, bills, "id", "g", "c", "days").orderBy("id")
    assert [r[2:] for r in rows(got)] == [(10.0, 6.0, 5.0), (3.0, 2.0, None), (None, None, None)]
    survey = features.add_survey(stays, frame("id int, s double", [(1, 9.0)]), "id", "s")
    assert rows(features.response_rate(survey, "satisfaction_score")) == [(33.3,)]


def test_measures(frame):
    df = frame(
        "k string, length_of_stay_days double, wait_minutes double, satisfaction_score double, readmitted_30d int, "
        "discharge_efficiency_bucket string, gross_charge double, margin double",
        [
            ("a", 2.0, 5.0, None, 1, measures.RUSHED, 10.0, 4.0),
            ("a", 4.0, 7.0, 90.0, 0, measures.RUSHED, 10.0, 5.0),
            ("b", 3.0, 9.0, None, 1, measures.EXCELLENT, 0.0, 0.0),
            ("b", 3.0, 9.0, None, None, None, 0.0, 0.0),
        ],
    )
    names = list(measures.definitions())
    got = {r["k"]: r.asDict() for r in measures.measures(df, names, ["k"]).collect()}
    assert got["a"]["margin_fraction"] == 0.45 and got["a"]["rushed_rate_pct"] == 50.0
    assert got["a"]["excellent_rate_pct"] is None and got["a"]["relative_risk"] is None
    assert got["b"]["margin_fraction"] is None and got["b"]["readmission_rate_pct"] == 50.0
    total = measures.measures(df, names).first()
    assert total["relative_risk"] == 0.5 and total["avg_satisfaction"] == 90.0 and total["total_admissions"] == 4
