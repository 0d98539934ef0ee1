"""Every registered query against its SQL, and the plans of the queries."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from opslens.plans.bindings import TestTables
from opslens.plans.oracle import ORACLE_SQL
from opslens.plans.queries import QUERIES as LIBRARY

FOLDER = "/root/testdata/sf0.001"
#: Figures of a fitted model, which SQL cannot express; ``test_model`` holds them against their definitions.
WITHOUT_SQL = {"m4_report", "m4_auc", "m10_shares"}
QUERIES, TEXTS = {k: entry.queries()[k] for k in LIBRARY}, dict(ORACLE_SQL)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) - set(TEXTS) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert compare(df, con, TEXTS[name]) == ""
    plan = df._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert banned not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_scan_reads_only_what_the_query_needs(spark):
    plan = QUERIES["q7_margin"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_discount:double>" in plan
    plan = QUERIES["j2_bad_rows"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), LessThanOrEqual(c_acctbal,0.0)]" in plan


@pytest.mark.parametrize("name", ["q3_outliers", "v2_box", "j8_impute_median", "q5_cut"])
def test_facts_are_not_shuffled_by_row(spark, name):
    """Lookups of statistics are broadcast after their size was checked; only partial aggregates are exchanged."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize(
    "name",
    ["q1_scorecard", "q7_margin", "q3_outliers", "v2_box", "v6_corr", "e5_dup_members", "j7_dedupe_first", "j8_impute_median",
     "j10_iqr_clip", "k7_features", "m2_split", "m7_auc", "m9_roc", "r1_hash_sample"],
)
def test_result_does_not_depend_on_the_partitioning(spark, con, monkeypatch, name, parts):
    read = TestTables.read
    monkeypatch.setattr(TestTables, "read", lambda self, table: read(self, table).repartition(parts))
    assert compare(QUERIES[name](spark, FOLDER), con, TEXTS[name]) == ""
