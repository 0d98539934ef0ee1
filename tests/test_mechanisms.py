"""Cube of measures, membership bitmaps, drill-down and spelling variants: plans, edges and brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from helpers import row_set, rows
from opslens.operators import cube, labels, measures, membership, reconcile
from opslens.operators.graph import components
from opslens.plans.bindings import TestTables
from opslens.plans.queries import QUERIES
from opslens.session import stored

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- cube -------------------------------------------------------------------------------------------------------------


def test_cube_scans_the_facts_once(spark):
    text = plan(QUERIES["t_cube"](spark, FOLDER)).split("Initial Plan")[0]
    assert text.count("lineitem.parquet") == 1 and text.count("Expand") == 2


FACTS = """a string, b int, k long, m long, length_of_stay_days double, wait_minutes double, satisfaction_score double, readmitted_30d int,
    discharge_efficiency_bucket string, gross_charge decimal(12,2), margin decimal(12,2)"""


def facts(spark, n=400):
    rng = random.Random(4)
    from decimal import Decimal

    some = lambda x: None if rng.random() < 0.1 else x
    return spark.createDataFrame(
        [(some(rng.choice("xyz")), some(rng.randint(1, 3)), some(rng.choice([0, -1, -40000, 5, 32768, 32769, 10**12, rng.randint(-9, 99)])), some(rng.randint(1, 70000)),
          some(rng.random() * 9), some(3.5), some(80.0), some(rng.randint(0, 1)), some(rng.choice([measures.RUSHED, measures.EXCELLENT, "40-60"])),
          some(Decimal(rng.randint(1, 999))), some(Decimal(rng.randint(-9, 99)))) for _ in range(n)], FACTS)


def test_every_slice_equals_the_measures_of_its_own_scan(spark):
    df = stored(facts(spark).repartition(5))
    names = list(cube.parts())
    got = stored(cube.measure_cube(df, names, ["a", "b"], {"ks": "k", "ms": "m"}))
    assert set(names) == set(measures.definitions())
    for n in range(3):
        for by in combinations(["a", "b"], n):
            left_out = sum(bit for c, bit in (("a", 2), ("b", 1)) if c not in by)
            want = measures.measures(df, names, by)
            keys = df.groupBy(*by).agg(F.count_distinct("k").alias("ks"), F.count_distinct("m").alias("ms"))
            mine = got.where(F.col("slice") == left_out)
            assert row_set(mine.select(*by, *names)) == row_set(want.select(*by, *names))
            assert row_set(mine.select(*by, "ks", "ms")) == row_set(keys.select(*by, "ks", "ms"))


def test_cube_without_distinct_counts_or_rows(spark):
    df = facts(spark, 50)
    got = cube.measure_cube(df, ["total_admissions"], ["a"])
    assert row_set(got.where("slice = 1").select("total_admissions")) == {(50,)} and got.where("slice = 0").count() == df.select("a").distinct().count()
    assert cube.measure_cube(df.limit(0), ["total_admissions"], ["a"], {"ks": "k"}).where("slice = 0").count() == 0


# --- membership -------------------------------------------------------------------------------------------------------

KEYS = [0, 1, -1, -32767, -32768, 32768, 32769, 63, 64, 65, 2**40, -(2**40), 2**62]


@pytest.mark.parametrize("small_rows", [200_000, 0])
def test_membership_of_sparse_repeated_negative_and_null_keys(spark, small_rows):
    rng = random.Random(1)
    parents = KEYS[::2] + [rng.randint(-(10**6), 10**6) for _ in range(300)] * 2 + [None]
    children = KEYS * 3 + [rng.choice(parents) for _ in range(500)] + [rng.randint(-(10**6), 10**6) for _ in range(500)] + [None] * 4
    p = spark.createDataFrame([(k,) for k in parents], "pk long").repartition(3)
    c = spark.createDataFrame([(k, i) for i, k in enumerate(children)], "fk long, row int").repartition(4)
    bits = stored(membership.bitmap(p, "pk"))
    want = {i for i, k in enumerate(children) if k is None or k not in set(parents)}
    lost = membership.rows_without_parent(c, "fk", bits, small_rows)
    assert lost.columns == ["fk", "row"] and sorted(r.row for r in lost.collect()) == sorted(want)
    rule = membership.foreign_key_rules(c, {"fk -> pk": ("fk", bits), "row -> pk": ("row", bits)}, small_rows)
    rows_lost = sum(i not in set(parents) for i in range(len(children)))
    assert row_set(rule) == {("fk -> pk", len(want), False), ("row -> pk", rows_lost, False)}
    none = stored(membership.bitmap(p.limit(0), "pk"))
    assert membership.rows_without_parent(c, "fk", none, small_rows).count() == len(children)
    assert membership.rows_without_parent(c.limit(0), "fk", bits, small_rows).count() == 0


def test_bitmap_is_never_longer_than_its_keys(spark):
    dense = membership.bitmap(spark.range(1, 64_001), "id")
    assert dense.count() == 1000
    assert membership.bitmap(spark.range(0, 10**9, 10**6), "id").count() == 1000


def test_bitmap_rules_shuffle_no_child_keys_and_scan_a_child_once(spark):
    t = TestTables(spark, FOLDER)
    links = {"p": ("l_partkey", stored(membership.bitmap(t.read("part"), "p_partkey"))), "s": ("l_suppkey", stored(membership.bitmap(t.read("supplier"), "s_suppkey")))}
    text = plan(membership.foreign_key_rules(t.read("lineitem"), links))
    assert text.count("lineitem.parquet") == 1 and "SortMergeJoin" not in text and "ENSURE_REQUIREMENTS" in text and "hashpartitioning" not in text
    assert row_set(QUERIES["j13_fk_bitmap"](spark, FOLDER)) == row_set(QUERIES["j13_fk"](spark, FOLDER))


# --- drill-down -------------------------------------------------------------------------------------------------------

COPY = "k long, v string, w double"


def changes(left, right):
    count = lambda side: {k: sorted(map(repr, [r for r in side if r[0] == k])) for k in {r[0] for r in side}}
    a, b = count(left), count(right)
    return {(k, len(a.get(k, [])), len(b.get(k, [])), "missing" if k not in b else "extra" if k not in a else "changed")
            for k in a.keys() | b.keys() if a.get(k) != b.get(k)}


@pytest.mark.parametrize("fanout, leaf_rows", [(1024, 100_000), (4, 3), (2, 1), (300, 10)])
def test_drilldown_names_missing_extra_and_changed_rows(spark, fanout, leaf_rows):
    rng = random.Random(fanout)
    left = [(rng.randint(-500, 5000), rng.choice(["a", None, ""]), rng.choice([1.5, None])) for _ in range(800)]
    left += [(None, "x", 1.0)] * 3 + [(10**15 if fanout > 100 else 9000, "far", None), (7, "a", None), (8, None, None), (9, "a", 1.0), (9, "a", 1.0)]
    right = [r for i, r in enumerate(left) if i % 53] + [(7, None, 1.5), (9999, "new", 2.0), (None, "x", 1.0)] + [(9, "a", 1.0)] * 2
    rng.shuffle(right)
    a, b = spark.createDataFrame(left, COPY).repartition(3), spark.createDataFrame(right, COPY).repartition(5)
    assert row_set(reconcile.drilldown(a, b, "k", ["v", "w"], fanout, leaf_rows)) == changes(left, right)
    assert rows(reconcile.drilldown(a, a.repartition(2), "k", ["v", "w"], fanout, leaf_rows)) == []
    none = a.limit(0)
    assert reconcile.drilldown(none, none, "k", ["v"], fanout, leaf_rows).count() == 0
    assert reconcile.drilldown(a, none, "k", ["v", "w"], fanout, leaf_rows).count() == len({r[0] for r in left})


def test_drilldown_of_equal_copies_shuffles_only_checksums(spark, monkeypatch):
    """No row is compared, and what is exchanged are partial sums per range."""
    t = TestTables(spark, FOLDER)
    orders, seen = t.read("orders"), []
    unequal = reconcile._unequal
    monkeypatch.setattr(reconcile, "_unequal", lambda a, b: seen.append((a, b)) or unequal(a, b))
    monkeypatch.setattr(reconcile, "_within", lambda *_: pytest.fail("rows were read again"))
    assert reconcile.drilldown(orders, orders.repartition(3), "o_orderkey", ["o_custkey"], fanout=16).count() == 0
    assert len(seen) == 1
    text = plan(seen[0][0])
    assert "partial_bit_xor" in text and text.index("partial_bit_xor") > text.index("Exchange") and seen[0][0].count() == 16


def test_drilldown_reads_only_unequal_ranges_again(spark, monkeypatch):
    df = spark.range(100_000).withColumn("v", F.col("id") % 7)
    folder = stored(df)
    other = stored(df.withColumn("v", F.when(F.col("id").isin(12_345, 77_000), -1).otherwise(F.col("v"))))
    read = []
    within = reconcile._within
    monkeypatch.setattr(reconcile, "_within", lambda *a: read.append(within(*a)) or read[-1])
    found = reconcile.drilldown(folder, other, "id", ["v"], fanout=100, leaf_rows=50)
    assert row_set(found.select("key", "status")) == {(12_345, "changed"), (77_000, "changed")}
    assert [r.count() for r in read] == [2000, 2000, 20, 20]
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(id,12000)" in plan(read[0])


# --- spelling variants ------------------------------------------------------------------------------------------------


def edits_apart(a: str, b: str) -> bool:
    """At most one letter more, less or replaced, or one swap of neighbours, that leaves the figures as they are."""
    if a == b:
        return True
    if [c for c in a if c.isdigit()] != [c for c in b if c.isdigit()] or min(len(a), len(b)) < labels.LEAST_LENGTH:
        return False
    if len(a) == len(b):
        wrong = [i for i in range(len(a)) if a[i] != b[i]]
        return len(wrong) == 1 or (len(wrong) == 2 and wrong[1] == wrong[0] + 1 and a[wrong[0]] == b[wrong[1]] and a[wrong[1]] == b[wrong[0]])
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def clusters(counts):
    norm = lambda s: "".join(c for c in s.lower() if c.isalnum()) or s
    group = {s: {s} for s in counts}
    for a, b in combinations(counts, 2):
        if edits_apart(norm(a), norm(b)) and group[a] is not group[b]:
            both = group[a] | group[b]
            for s in both:
                group[s] = both
    return {(s, n, min(group[s], key=lambda x: (-counts[x], x)), len(group[s]), sum(counts[x] for x in group[s])) for s, n in counts.items()}


def test_variants_against_all_pairs(spark):
    rng = random.Random(2)
    base = ["Cardiology", "Emergency 1", "Emergency 2", "Oncology", "ER", "OR", "---", "Maternity", "Neuro-logy", "12345", "12354", "abcde", "abcdef"]
    raw = []
    for _ in range(500):
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(s))
            kind = rng.randrange(5)
            if kind == 0 and len(s) > 1:
                del s[i]
            elif kind == 1:
                s.insert(i, rng.choice("aey1 "))
            elif kind == 2:
                s[i] = rng.choice("aey2-")
            elif kind == 3 and i:
                s[i - 1], s[i] = s[i], s[i - 1]
            else:
                s[i] = s[i].upper()
        raw.append("".join(s))
    counts = {}
    for s in raw:
        counts[s] = counts.get(s, 0) + 1
    df = spark.createDataFrame([(s, i) for i, s in enumerate([*raw, None])], "raw string, row int").repartition(3)
    assert row_set(labels.variant_clusters(df, "raw")) == clusters(counts)
    names = {s: c for s, _, c, _, _ in clusters(counts)}
    got = labels.canonical_spelling(df, "raw", "name").select("row", "raw", "name")
    assert {r.row: r.name for r in got.collect()} == {i: names.get(s) for i, s in enumerate([*raw, None])}
    assert labels.variant_clusters(df.limit(0), "raw").count() == 0


def test_a_large_block_costs_a_link_a_member(spark):
    """All members of a block are one replacement apart; they are linked to one of them, not to each other."""
    norms = spark.createDataFrame([("depart" + chr(0x4E00 + i) + "ment",) for i in range(3000)], "norm string")
    links = stored(labels.spelling_links(norms))
    assert links.count() < 2 * 3000 and components(links).select("component").distinct().count() == 1


def test_components_of_chains_and_stars(spark):
    links = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 70)] + [("s", f"t{i}") for i in range(30)] + [("q", "q")]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {f"n{i:03d}": "n000" for i in range(71)} | {"s": "s"} | {f"t{i}": "s" for i in range(30)}
