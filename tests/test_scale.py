"""The operators that keep large groups, large lookups and hot keys apart."""

import struct
from contextlib import contextmanager

import numpy as np
import pytest
from helpers import row_set, rows
from pyspark.sql import functions as F

from opslens.operators import joins
from opslens.operators.joins import hot_keys, join_lookup, settle
from opslens.operators.quantiles import group_quantiles, select_ranks
from opslens.operators.rollups import Hop, sums_along
from opslens.operators.running import numbered, running_totals
from opslens.operators.sampling import hash_sample, key_hash, stratified_split

POINTS = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}


@contextmanager
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_settle_small_and_large(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 2)
    for limit in (1000, 100):
        again = settle(df, small_rows=limit)
        assert again.columns == df.columns and row_set(again) == row_set(df)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_keys", [False, True])
def test_join_lookup_is_the_same_on_every_path(spark, how, null_keys):
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50)  # key 7 holds a third of the rows
    if null_keys:
        key = F.when(F.col("id") % 10 == 1, None).otherwise(key)
    facts = spark.range(3000).select("id", key.alias("k"))
    lookup = spark.range(5, 40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    expected = row_set(facts.join(lookup, "k", how))
    assert row_set(join_lookup(facts, lookup, "k", how)) == expected
    for salted in (facts, facts.repartition(6)):
        assert row_set(join_lookup(salted, lookup, "k", how, small_rows=5, hot_sample=1.0)) == expected


def test_large_lookup_spreads_a_hot_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k")).repartition(9)
        lookup = spark.range(3000).select(F.col("id").alias("k"), F.col("id").alias("v"))
        joined = join_lookup(facts, lookup, "k", small_rows=10, hot_sample=1.0)
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert text.count("SortMergeJoin") == 1 and "Union" not in text
        tasks = joined.where("k = 7").groupBy(F.spark_partition_id()).count().collect()
        assert sum(t[1] for t in tasks) == 1001 and len(tasks) > 1 and max(t[1] for t in tasks) < 800
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_wide_text_is_not_broadcast(spark, monkeypatch):
    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert joins.is_small(wide) and not joins.is_small(wide, small_rows=50)
    monkeypatch.setattr(joins, "SMALL_BYTES", 10_000)
    assert not joins.is_small(wide) and joins.is_small(wide.select("id"))
    again = settle(wide)
    assert not again.isLocal() and row_set(again) == row_set(wide)


def test_hot_keys_are_bounded(spark):
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    assert rows(hot_keys(facts, ["k"], sample=1.0)) == [(7, 3)]
    assert hot_keys(facts.where("k <> 7"), ["k"], sample=1.0).isEmpty()
    unknown = facts.select(F.when(F.col("k") != 7, F.col("k")).alias("k"), F.lit(1).alias("j"))
    assert rows(hot_keys(unknown, ["k", "j"], sample=1.0)) == [(None, None, 3)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_unknown_keys_do_not_meet_in_one_task(spark, how):
    facts = spark.range(900).select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 40).alias("k"), F.lit(1).alias("j"))
    lookup = spark.range(30).select(F.col("id").alias("k"), F.lit(1).alias("j"), (F.col("id") + 100).alias("v"))
    got = join_lookup(facts, lookup, ["k", "j"], how, small_rows=5, hot_sample=1.0)
    assert row_set(got) == row_set(facts.join(lookup, ["k", "j"], how))


def samples():
    rng = np.random.default_rng(5)
    return {
        "heavy": np.exp(rng.normal(0, 6, 3000)),
        "few": rng.integers(0, 3, 2500).astype(float),
        "same": np.full(1200, 4.25),
        "small": rng.normal(0, 1, 7),
        "one": np.array([3.0]),
        None: rng.normal(5, 2, 900),
    }


@pytest.mark.parametrize("task_rows", [10**6, 800, 40, 1])
def test_group_quantiles_match_numpy(spark, task_rows):
    data = samples()
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [("one", None)], "g string, v double")
    got = {r["g"]: r for r in group_quantiles(df.repartition(7), ["g"], "v", POINTS, task_rows=task_rows).collect()}
    assert set(got) == set(data)
    for g, values in data.items():
        for name, p in POINTS.items():
            assert np.isclose(got[g][name], np.quantile(values, p), rtol=1e-12, atol=1e-12), (g, name)


def test_quantiles_have_the_same_bits_on_every_way(spark):
    inf, nan = float("inf"), float("nan")
    data = {"inf": [inf] * 8 + [1.0, 1.0], "low": [-inf, -inf, 0.5, 2.0, inf], "nan": [nan, 1.0, nan, 3.0], "zero": [-0.0, 0.0, -0.0, 1.0]}
    data |= {k: [float(v) for v in vs] for k, vs in samples().items()}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double").repartition(5)
    bits = lambda r: (r["g"], *(struct.pack(">d", r[name]) for name in POINTS))
    found = [{bits(r) for r in group_quantiles(df, ["g"], "v", POINTS, task_rows=n).collect()} for n in (10**6, 40, 1)]
    assert len(found[0]) == len(data) and found[0] == found[1] == found[2]


def test_orphans_under_a_hot_parent(spark):
    """A third of the parent rows share one key; both sides are reduced to a row per key before the exchange."""
    parents = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    children = spark.range(20).select((F.col("id") * 5000 + 7).alias("k"))
    with no_broadcast(spark):
        got = joins.orphan_counts(children, "k", parents, "k")
        plan = got._jdf.queryExecution().executedPlan().toString()
        want = {r[0] for r in children.collect()} - {r[0] for r in parents.distinct().collect()}
        assert {r["key"] for r in got.collect()} == want
    below = plan[plan.index("LeftAnti") :]
    assert below.count("HashAggregate") >= 4 and below.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("task_rows", [10**6, 50])
def test_quantiles_of_everything(spark, task_rows):
    values = samples()["heavy"]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    (got,) = rows(group_quantiles(df, [], "v", POINTS, task_rows=task_rows))
    assert np.allclose(got, [np.quantile(values, p) for p in POINTS.values()], rtol=1e-12)


@pytest.mark.parametrize("task_rows", [10**6, 30])
def test_select_ranks_counts_ties(spark, task_rows):
    df = spark.range(2000).select(F.struct((F.col("id") % 2).alias("g")).alias("_group"), F.floor(F.col("id") / 20).alias("v"))
    targets = df.select("_group").distinct().select("_group", F.explode(F.expr("array(0L, 555L, 999L)")).alias("k"))
    got = {(r[0][0], r[1]): tuple(r)[2:] for r in select_ranks(df, "v", targets, task_rows=task_rows).collect()}
    for g in (0, 1):
        assert got[(g, 0)] == (0, 0, 10) and got[(g, 555)] == (55, 550, 10) and got[(g, 999)] == (99, 990, 10)


@pytest.fixture(params=["true", "false"])
def merged(spark, request):
    """Small shuffles merged into one partition, and left apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, request.param)
    yield
    spark.conf.unset(name)


def test_running_totals(spark, merged):
    df = spark.range(1, 501).select(((F.col("id") * 37) % 503).alias("x"), F.lit(2).alias("n")).repartition(5)
    got = rows(running_totals(df, F.desc("x"), {"upto": "n"}).orderBy(F.desc("x")))
    assert [r[2] for r in got] == [2 * (i + 1) for i in range(500)]


def test_sums_along_hops(frame):
    facts = frame("fk int, x int", [(1, 10), (1, 5), (2, 7), (3, 1), (9, 100), (None, 3)])
    middle = frame("pk int, region int", [(1, 1), (2, 1), (3, 2)])
    top = frame("region int, name string", [(1, "a"), (2, "b")])
    hops = [Hop("fk", middle, "pk", ["region"]), Hop("region", top, "region", ["name"])]
    assert row_set(sums_along(facts, hops, ["name"], {"x": F.col("x"), "n": F.lit(1)})) == {("a", 22, 3), ("b", 1, 1)}
    assert row_set(sums_along(facts, hops[:1], ["region"], {"x": F.col("x")})) == {(1, 22), (2, 1)}
    assert row_set(sums_along(facts, [], ["fk"], {"x": F.col("x")})) == {(1, 15), (2, 7), (3, 1), (9, 100), (None, 3)}


def test_hash_sample_is_stable(spark):
    df = spark.range(20000)
    first = row_set(hash_sample(df, ["id"], 0.1))
    assert first == row_set(hash_sample(df.repartition(7), ["id"], 0.1)) and 1800 < len(first) < 2200


def test_split_is_exact_per_class(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("y"))
    split = stratified_split(df, "y", ["id"])
    counts = {(r[0], r[1]): r[2] for r in split.groupBy("y", "split").count().collect()}
    assert counts == {(1, "train"): 240, (1, "test"): 60, (0, "train"): 2160, (0, "test"): 540}
    ordered = df.where("y = 1").orderBy(key_hash(["id"])).limit(240).select("id")
    assert row_set(ordered) == row_set(split.where("y = 1 and split = 'train'").select("id"))


def test_split_with_equal_keys_at_the_cut(frame):
    df = frame("id int, y int", [(1, 0)] * 10 + [(2, 1)] + [(i, 2) for i in range(10, 15)])
    counts = {(r[0], r[1]): r[2] for r in stratified_split(df, "y", ["id"]).groupBy("y", "split").count().collect()}
    assert counts == {(0, "train"): 8, (0, "test"): 2, (1, "test"): 1, (2, "train"): 4, (2, "test"): 1}


def test_constants_are_sane():
    assert joins.HOT_PARTITIONS >= 1 and joins.SMALL_ROWS < 10**6


def test_rows_are_numbered_per_group(spark, merged):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g")).repartition(6)
    got = rows(numbered(df, "g", "n"))
    for g in range(3):
        size = sum(1 for r in got if r[1] == g)
        assert sorted(r[2] for r in got if r[1] == g) == list(range(1, size + 1))
