import pytest
from helpers import row_set, rows
from pyspark.sql import functions as F

from opslens.operators import cleaning, quality

NEAR = dict(rel=1e-9)


@pytest.fixture
def stays(frame):
    return frame(
        "id int, person int, kind string, wait double",
        [(1, 10, "a", 5.0), (1, 10, "a", 5.0), (4, 10, "a", 7.0), (2, 11, None, -5.0), (3, 11, None, 0.0), (5, 12, "b", None)],
    )


def test_duplicates(stays):
    key = ["person", "kind"]
    assert row_set(quality.duplicate_keys(stays, key)) == {(10, "a", 3), (11, None, 2)}
    members = quality.duplicate_members(stays, key)
    assert members.count() == 5 and members.columns == stays.columns
    assert rows(quality.preview(members, ["person", "id"], 2)) == [(1, 10, "a", 5.0)] * 2
    assert rows(quality.surplus_rows(stays, key)) == [(6, 3, 50.0)]
    assert rows(quality.surplus_rows(stays.limit(0), key)) == [(0, 0, None)]


def test_dedupe_keeps_first_by_the_given_order(stays):
    kept = cleaning.dedupe_first(stays, ["person", "kind"], ["id"])
    assert row_set(kept) == {(1, 10, "a", 5.0), (2, 11, None, -5.0), (5, 12, "b", None)}
    for n in (1, 7):
        again = cleaning.dedupe_first(stays.repartition(n), ["person", "kind"], ["id"])
        assert row_set(again) == row_set(kept)


def test_dedupe_limits_rows_before_the_shuffle(stays):
    plan = cleaning.dedupe_first(stays, ["person"], ["id"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_impute_group_median(frame):
    df = frame(
        "g int, v double",
        [(1, 1.0), (1, 2.0), (1, 3.0), (1, 10.0), (1, -4.0), (2, 0.0), (2, -1.0), (3, None), (3, 8.0), (None, -1.0)],
    )
    got = sorted(rows(cleaning.impute_group_median(df, "g", "v")), key=str)
    expected = [(1, 1.0), (1, 2.0), (1, 3.0), (1, 10.0), (1, 2.5), (2, None), (2, None), (3, None), (3, 8.0), (None, None)]
    assert got == sorted(expected, key=str)
    small = sorted(rows(cleaning.impute_group_median(df, "g", "v", task_rows=1)), key=str)
    assert small == got


def test_canonical_label_and_audit(frame):
    df = frame("id int, g int, raw string", [(1, 1, "CARDIO"), (2, 1, "cardio"), (3, 9, "x")])
    labels = frame("g int, label string, beds int", [(1, "Cardio", 3), (2, "ICU", 1)])
    slim, audit = cleaning.split_audit(cleaning.canonical_label(df, "g", labels, "label"), "raw", ["id", "label"])
    assert "raw" not in slim.columns
    assert row_set(audit) == {(1, "Cardio", "CARDIO"), (2, "Cardio", "cardio"), (3, None, "x")}


def test_iqr_clip(frame):
    df = frame("a double, b double", [(float(i), 1.0) for i in range(1, 9)] + [(100.0, None), (-100.0, 1.0)])
    bounds = {r[0]: r[1:] for r in rows(cleaning.iqr_bounds(df, ["a", "b"], 3))}
    assert bounds["a"] == pytest.approx((2.25 - 13.5, 6.75 + 13.5)) and bounds["b"] == (1.0, 1.0)
    clipped = cleaning.iqr_clip(df, ["a", "b"], 3)
    assert clipped.agg(F.max("a"), F.min("a"), F.count("b")).first()[:] == (20.25, -11.25, 9)
    assert {r[0]: r[3] for r in rows(cleaning.clip_counts(df, ["a", "b"], 3))} == {"a": 2, "b": 0}


def test_profile(stays):
    assert ("kind", "string", 4) in row_set(quality.schema_info(stays))
    assert row_set(quality.null_counts(stays, only_missing=True)) == {("kind", 2), ("wait", 1)}
    assert rows(quality.missing_fields(stays, ["kind", "wait"])) == [(2, 1, 6)]
    assert rows(quality.value_counts(stays, "kind")) == [("a", 3), ("b", 1)]
    assert (None, 2) in rows(quality.value_counts(stays, "kind", dropna=False))
    assert row_set(quality.value_shares(stays, "kind")) == {("a", 0.75), ("b", 0.25)}
    assert rows(quality.bad_share(stays, F.col("wait") <= 0)) == [(2, 33.33)]
    assert row_set(quality.non_positive_rows(stays, "wait", ["id", "wait"])) == {(2, -5.0), (3, 0.0)}


def test_describe(frame):
    df = frame("a double, b int", [(1.0, 1), (2.0, None), (3.0, 1), (4.0, None)])
    got = {r["field"]: r for r in quality.describe(df, ["a", "b"]).collect()}
    assert got["a"][1:] == (4, 2.5, 1.29, 1.0, 1.75, 2.5, 3.25, 4.0)
    assert got["b"][1:] == (2, 1.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0)


def test_rules(stays):
    rules = {"wait positive": F.col("wait") > 0, "id given": F.col("id").isNotNull()}
    assert row_set(quality.row_rules(stays, rules)) == {("wait positive", 3, False), ("id given", 0, True)}
    lenient = quality.row_rules(stays, rules, null_passes=True)
    assert ("wait positive", 2, False) in row_set(lenient)
    assert rows(quality.unique_rule(stays, ["id"], "u")) == [("u", 1, False)]
    assert rows(quality.domain_rule(stays, "kind", ["a"], "d")) == [("d", 1, False)]
    assert rows(quality.domain_rule(stays, "kind", ["a", "b"], "d")) == [("d", 0, True)]


def test_require(stays):
    quality.require(quality.row_rules(stays, {"fine": F.col("id") > 0}))
    with pytest.raises(AssertionError, match="wait: 3 violations"):
        quality.require(quality.row_rules(stays, {"wait": F.col("wait") > 0}))


def test_foreign_keys_and_orphans(frame):
    child = frame("id int, fk int", [(1, 1), (2, 9), (3, 9), (4, None)])
    parent = frame("pk int", [(1,), (2,)])
    assert rows(quality.foreign_key_rule(child, "fk", parent, "pk", "r")) == [("r", 3, False)]
    assert row_set(quality.orphan_rows(child, "fk", parent, "pk")) == {(2, 9), (3, 9), (4, None)}
    assert rows(quality.foreign_key_rule(child.where("fk = 1"), "fk", parent, "pk", "r")) == [("r", 0, True)]


def test_reconcile(frame):
    left, right = frame("k int", [(1,), (2,), (2,)]), frame("k int", [(2,), (3,)])
    assert rows(quality.reconcile_keys(left, right, "k")) == [(3, 2, 1, 1, False)]
    assert rows(quality.reconcile_keys(left, left.repartition(3), "k")) == [(3, 3, 0, 0, True)]
    a, b = frame("x int, y double, z int", [(1, 2.5, None)]), frame("x int, y double, z int", [(1, 2.0, None)])
    got = row_set(quality.reconcile_metrics(a, b, ["x", "y", "z"]))
    assert got == {("x", 1.0, 1.0, True), ("y", 2.5, 2.0, False), ("z", None, None, True)}


def test_variants(frame):
    df = frame("t string", [("ER",), ("Emergency",), ("ER",), (None,)])
    assert [r[0] for r in rows(quality.label_variants(df, "t"))] == [None, "ER", "Emergency"]
