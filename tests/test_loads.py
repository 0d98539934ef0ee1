"""Quarantine, publication, observed writes, incremental state, buckets."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from helpers import row_set, rows
from opslens.operators import observed, quality, trends
from opslens.plans import operations as ops
from opslens.plans.queries import QUERIES
from opslens.sources.publish import Published
from opslens.sources.quarantine import read_with_quarantine
from test_operations import raw_tables

FOLDER = "/root/testdata/sf0.001"


# --- quarantine -------------------------------------------------------------------------------------------------------

LINES = """id,name,price,day
1,plain,1.5,2024-01-01
2,"quoted, \\"with\\" comma",2,2024-01-02
3,,3.5,
4,short,1.0
5,long,1.0,2024-01-01,extra,more
six,bad id,1.0,2024-01-01
7,bad price,one,2024-13-01
,no id,1.0,2024-01-01
"9","x",9.25,"2024-02-29"
10,"unclosed,1.0,2024-01-01
"""
SCHEMA = "id int, name string, price double, day date"


def test_every_line_is_good_or_has_a_reason(spark, tmp_path):
    (tmp_path / "a.csv").write_text(LINES)
    (tmp_path / "b.csv").write_text("id,name,price,day\n11,second file,1,2024-01-01\n")
    load = read_with_quarantine(spark, str(tmp_path), SCHEMA, ["id"])
    day = dt.date
    assert row_set(load.good) == {
        (1, "plain", 1.5, day(2024, 1, 1)), (2, 'quoted, "with" comma', 2.0, day(2024, 1, 2)), (3, None, 3.5, None),
        (9, "x", 9.25, day(2024, 2, 29)), (11, "second file", 1.0, day(2024, 1, 1)),
    }
    bad = {r.raw.split(",")[0]: r.reasons for r in load.bad.collect()}
    assert bad == {
        "4": ["too few fields"], "5": ["too many fields"], "six": ["id is not int"], "7": ["price is not double", "day is not date"],
        '""': ["id is missing"], "10": bad["10"],
    } or bad == {
        "4": ["too few fields"], "5": ["too many fields"], "six": ["id is not int"], "7": ["price is not double", "day is not date"],
        "": ["id is missing"], "10": bad["10"],
    }
    counts = dict(rows(load.counts()))
    assert counts["good"] == 5 and sum(counts.values()) == 11


def test_a_file_without_bad_rows_and_one_without_good_ones(spark, tmp_path):
    (tmp_path / "good.csv").write_text("1,a,1,2024-01-01\n")
    (tmp_path / "bad.csv").write_text("x\ny,z\n")
    good = read_with_quarantine(spark, str(tmp_path / "good.csv"), SCHEMA, header=False)
    assert (good.good.count(), good.bad.count()) == (1, 0)
    bad = read_with_quarantine(spark, str(tmp_path / "bad.csv"), SCHEMA, header=False)
    assert (bad.good.count(), bad.bad.count()) == (0, 2)


# --- publication ------------------------------------------------------------------------------------------------------


def test_readers_follow_the_newest_whole_version(spark, tmp_path):
    results = Published(spark, str(tmp_path / "out"))
    with pytest.raises(FileNotFoundError):
        results.read("a")
    with results.write() as version:
        assert version.put("a", spark.range(3)).count() == 3
        with pytest.raises(FileNotFoundError):
            results.read("a")
    assert results.read("a").count() == 3
    with pytest.raises(ZeroDivisionError), results.write() as version:
        version.put("a", spark.range(9))
        raise ZeroDivisionError
    assert results.read("a").count() == 3
    with results.write() as version:
        version.put("a", spark.range(5))
        version.put("b", spark.range(1))
    assert (results.read("a").count(), results.read("b").count(), results.manifest()["number"]) == (5, 1, 2)
    assert len(os.listdir(tmp_path / "out" / "versions")) == 3
    assert len(results.vacuum()) == 2 and results.read("a").count() == 5 and results.vacuum() == []


def test_of_two_runs_at_once_one_is_refused(spark, tmp_path):
    results = Published(spark, str(tmp_path))
    with pytest.raises(RuntimeError), results.write() as first:
        first.put("a", spark.range(1))
        with results.write() as second:
            second.put("a", spark.range(2))
        # the first run has not seen that manifest number 1 is taken
        results.manifest = lambda: {"number": 0, "version": "", "results": []}
        results._commit({"number": 1, "version": first.name, "results": ["a"]})
    assert Published(spark, str(tmp_path)).read("a").count() == 2


def test_a_run_killed_midway_leaves_the_old_results_and_can_be_run_again(spark, tmp_path, monkeypatch):
    folder = tmp_path / "raw"
    folder.mkdir()
    raw, out = str(raw_tables(folder)), str(tmp_path / "out")
    results = ops.publish(spark, raw, out, with_model=False)
    before = row_set(spark.read.parquet(f"{results.path('tables')}/admissions").select("admission_id", "wait_minutes"))
    with monkeypatch.context() as patch:
        patch.setattr(ops, "feature_table", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            ops.publish(spark, raw, out, with_model=False)
    old = results.path("tables")
    assert row_set(spark.read.parquet(f"{old}/admissions").select("admission_id", "wait_minutes")) == before
    ops.publish(spark, raw, out, with_model=False)
    assert results.path("tables") != old and results.manifest()["number"] == 2
    assert row_set(spark.read.parquet(f"{results.path('tables')}/admissions").select("admission_id", "wait_minutes")) == before
    assert set(results.manifest()["results"]) == set(os.listdir(os.path.dirname(results.path("tables"))))


# --- rules observed while writing -------------------------------------------------------------------------------------


def test_rules_are_judged_in_the_writing_pass(spark, frame, tmp_path):
    df = frame("a int, b string", [(1, "x"), (0, None), (None, "y"), (5, "z")]).repartition(3)
    tests = {"a is positive": F.col("a") > 0, "b is given": F.col("b").isNotNull()}
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("observed", "one write")
    judged = observed.observed_write(df, tests, lambda d: d.write.parquet(str(tmp_path / "t")))
    n_jobs = len(jobs.getJobIdsForGroup("observed"))
    spark.sparkContext.setJobGroup("plain", "one write")
    df.write.parquet(str(tmp_path / "u"))
    assert n_jobs == len(jobs.getJobIdsForGroup("plain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert row_set(judged) == {("rows written", 4, True), ("a is positive", 2, False), ("b is given", 1, False)}
    assert row_set(judged.where("rule <> 'rows written'")) == row_set(quality.row_rules(spark.read.parquet(str(tmp_path / "t")), tests))
    loose = observed.observed_write(df, tests, lambda d: d.write.format("noop").mode("overwrite").save(), null_passes=True)
    assert row_set(loose) == {("rows written", 4, True), ("a is positive", 1, False), ("b is given", 1, False)}


def test_a_gate_lets_only_whole_tables_through(spark, frame):
    done = []
    write = lambda d: d.write.format("noop").mode("overwrite").save()
    observed.gated_write(frame("a int", [(1,)]), {"a is positive": F.col("a") > 0}, write, lambda: done.append("good"))
    with pytest.raises(AssertionError, match="a is positive: 1 violations"):
        observed.gated_write(frame("a int", [(1,), (-1,)]), {"a is positive": F.col("a") > 0}, write, lambda: done.append("bad"))
    assert done == ["good"]
    empty = observed.observed_write(frame("a int", []), {"a is positive": F.col("a") > 0}, write)
    assert row_set(empty) == {("rows written", 0, True), ("a is positive", 0, True)}


# --- incremental months -----------------------------------------------------------------------------------------------


def months(frame, *days):
    return frame("id int, day date", [(i, None if d is None else dt.date.fromisoformat(d)) for i, d in enumerate(days)])


def stamps(state):
    return {m: sorted((f, os.stat(f"{state}/{m}/{f}").st_mtime_ns) for f in os.listdir(f"{state}/{m}")) for m in os.listdir(state) if m.startswith("month=")}


def test_late_rows_change_only_their_month(spark, frame, tmp_path):
    state = str(tmp_path / "state")
    first = months(frame, "2024-01-05", "2024-01-06", "2024-02-01", "2024-03-09", "2024-03-10", None)
    assert trends.read_state(spark, state) is None
    assert trends.add_load(state, first, "day", "a").count() == 3
    before = stamps(state)
    changed = trends.add_load(state, months(frame, "2024-02-28", "2024-05-01"), "day", "b")
    assert row_set(changed) == {("2024-02-01",), ("2024-05-01",)}
    after = stamps(state)
    assert {m for m in after if after[m] != before.get(m)} == {"month=2024-02-01", "month=2024-05-01"}
    both = first.unionByName(months(frame, "2024-02-28", "2024-05-01"))
    assert rows(trends.trend_of_state(spark, state, min_periods=3)) == rows(trends.monthly_trend(both, "day", min_periods=3))


def test_a_load_that_is_run_again_replaces_itself(spark, frame, tmp_path):
    state = str(tmp_path / "state")
    trends.add_load(state, months(frame, "2024-01-05", "2024-02-06"), "day", "a")
    trends.add_load(state, months(frame, "2024-01-07"), "day", "b")
    trends.add_load(state, months(frame, "2024-01-05", "2024-01-09", "2024-03-06"), "day", "a")
    whole = months(frame, "2024-01-05", "2024-01-09", "2024-03-06", "2024-01-07")
    assert rows(trends.trend_of_state(spark, state)) == rows(trends.monthly_trend(whole, "day"))


# --- plans ------------------------------------------------------------------------------------------------------------


def test_features_over_buckets_need_no_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the tables are too large to be broadcast at scale
    try:
        plan, other = (QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString() for name in ("k7_bucketed", "k7_features"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 3 and plan.count("Bucketed: true") == 4 and "Exchange hashpartitioning" not in plan
    assert "Exchange hashpartitioning" in other


def test_correlations_are_one_aggregate(spark):
    plan = QUERIES["v6_corr"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Scan parquet") == 1
