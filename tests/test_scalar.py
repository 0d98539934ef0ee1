import datetime as dt
import math

from pyspark.sql import functions as F

from opslens.functions import scalar as fn
from opslens.operators.features import AGE_EDGES, AGE_LABELS, EFFICIENCY_EDGES, EFFICIENCY_LABELS
from opslens.operators.kpis import SCORE_EDGES, SCORE_LABELS, WAIT_BANDS, WAIT_EDGES, WAIT_LABELS, WAIT_LAST


def column(frame, values, expression, kind="double"):
    df = frame(f"i int, x {kind}", list(enumerate(values)))
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_width_bucket_is_left_closed(frame):
    scores = [0.0, 20.0, 40.0, 60.0, 80.0, 100.0, -1.0, 101.0, None]
    got = column(frame, scores, fn.width_bucket(F.col("x"), 0, 100, 5))
    assert got == [1, 2, 3, 4, 5, 6, 0, 6, None]


def test_bins_are_right_closed_and_null_outside(frame):
    scores = [0.0, 20.0, 40.0, 60.0, 80.0, 100.0, -1.0, 101.0, None]
    got = column(frame, scores, fn.bin_label(F.col("x"), SCORE_EDGES, SCORE_LABELS))
    assert got == [None, "0-20", "20-40", "40-60", "60-80", "80-100", None, None, None]
    got = column(frame, [40.0, 40.1, 0.0], fn.bin_label(F.col("x"), EFFICIENCY_EDGES, EFFICIENCY_LABELS))
    assert got == ["Rushed (0-40)", "Below Avg (40-60)", None]
    left = column(frame, [0.0, 20.0, 100.0], fn.bin_index(F.col("x"), SCORE_EDGES, right=False))
    assert left == [0, 1, None]


def test_wait_bands_both_readings(frame):
    waits = [0.0, 15.0, 30.0, 60.0, 14.9]
    case = column(frame, waits, fn.upper_bands(F.col("x"), WAIT_BANDS, WAIT_LAST))
    assert case == ["<15 min", "15-30 min", "30-60 min", "60+ min", "<15 min"]
    cut = column(frame, waits, fn.bin_label(F.col("x"), WAIT_EDGES, WAIT_LABELS))
    assert cut == ["<15 min", "<15 min", "15-30 min", "30-60 min", "<15 min"]


def test_half_up_rounding(frame):
    assert column(frame, [1.005, 2.5, -2.5, 0.125, None], fn.half_up(F.col("x"), 2)) == [1.01, 2.5, -2.5, 0.13, None]
    assert column(frame, [0.5, 1.5, 2.5, -0.5], fn.half_up(F.col("x"), 0)) == [1.0, 2.0, 3.0, -1.0]


def test_clamp_keeps_null(frame):
    got = column(frame, [-1.0, 0.5, 9.0, None], fn.clamp(F.col("x"), F.lit(0.0), F.lit(1.0)))
    assert got == [0.0, 0.5, 1.0, None]


def test_division_guards(frame):
    df = frame("a double, b double", [(1.0, 0.0), (1.0, None), (1.0, 4.0)])
    assert [r[0] for r in df.select(fn.ratio(F.col("a"), F.col("b"))).collect()] == [None, None, 0.25]
    z = df.select(fn.z_score(F.col("a"), F.lit(0.5), F.lit(0.0))).first()[0]
    assert z is None


def test_rate_keeps_unknown_flags_in_the_denominator(frame):
    df = frame("flag int", [(1,), (0,), (None,), (None,)])
    assert tuple(df.agg(fn.rate_pct(F.col("flag")), fn.rate_of_known_pct(F.col("flag"))).first()) == (25.0, 50.0)


def test_weekend_and_month(frame):
    days = [dt.datetime(2024, 1, d) for d in (5, 6, 7, 8)]  # Friday to Monday
    got = column(frame, days, fn.is_weekend(F.col("x")), "timestamp_ntz")
    assert got == [False, True, True, False]
    assert column(frame, days[:1], fn.month_start(F.col("x")), "timestamp_ntz") == [dt.date(2024, 1, 1)]
    assert column(frame, days[:1], fn.month_label(F.col("x")), "timestamp_ntz") == ["2024-01"]
    assert column(frame, days[:1], fn.in_months(F.col("x"), [12, 1, 2]), "timestamp_ntz") == [True]


def test_age_bands(frame):
    event = F.lit("2020-01-01").cast("date")
    births = [dt.date(2020, 6, 1), dt.date(2020, 1, 1), dt.date(2001, 12, 31), dt.date(2001, 11, 25), None]
    ages = column(frame, births, fn.age_years(event, F.col("x")), "date")
    assert ages[0] < 0 and ages[1] == 0.0 and ages[2:] == [18.0, 18.1, None]
    bands = column(frame, births, fn.bin_label(fn.age_years(event, F.col("x")), AGE_EDGES, AGE_LABELS), "date")
    assert bands == [None, None, "0-18", "19-35", None]


def test_add_fractional_days(frame):
    start = F.lit("2024-02-28 00:00:00").cast("timestamp_ntz")
    got = column(frame, [1.5, 0.0, 2.1], fn.add_days(start, F.col("x")))
    assert got == [
        dt.datetime(2024, 2, 29, 12), dt.datetime(2024, 2, 28), dt.datetime(2024, 3, 1, 2, 24)
    ]


def test_logistic_and_season(frame):
    got = column(frame, [0.0, 2.0], fn.logistic(F.col("x")))
    assert got[0] == 0.5 and math.isclose(got[1], 1 / (1 + math.exp(-2)))
    days = [dt.date(2024, 1, 6), dt.date(2024, 3, 4)]
    assert column(frame, days, fn.calendar_factor(F.col("x"), {1: 1.4}, 1.15), "date") == [1.4 * 1.15, 1.0]
    assert column(frame, days, fn.calendar_factor(F.col("x"), {}), "date") == [1.0, 1.0]


def test_labels(frame):
    assert column(frame, [499263162.0], fn.millions_label(F.col("x"))) == ["$499.3M"]
    assert column(frame, [46500.0], fn.thousands_label(F.col("x"))) == ["46,500"]
