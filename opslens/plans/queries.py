"""Registered queries: each takes (spark, folder of test tables) and returns a frame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opslens.functions import scalar as fn
from opslens.operators import cleaning, cube, distributions, features, kpis, labels, measures, membership, model, quality, reconcile, sampling, trends
from opslens.operators.joins import join_lookup
from opslens.operators.observed import observed_write
from opslens.operators.rollups import sums_along
from opslens.plans.bindings import TestTables, money
from opslens.session import run_name, run_path, spread, stored
from opslens.sources import tables
from opslens.sources.publish import Published
from opslens.sources.quarantine import read_with_quarantine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
ROW_KEY = [*LINE_KEY, *LINE_ORDER]
MODEL_CATEGORIES = ["p_type", "p_brand", "l_linestatus"]
MODEL_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


#: Buckets of the tables that are kept by the stay's key; at scale one for each 128 MB to 1 GB.
BUCKETS = 8


def query(name: str) -> Callable:
    """Register a function of the test tables. Dates leave as ISO text, decimals as doubles."""

    def register(build: Callable[[TestTables], DataFrame]) -> Callable[[TestTables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(build(TestTables(spark, folder)))

        QUERIES[name] = run
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """The same rows in types that every engine prints alike."""

    def cast(name: str, dtype: str):
        column = F.col(f"`{name}`")
        if dtype == "date":
            return F.date_format(column, "yyyy-MM-dd").alias(name)
        if dtype.startswith("timestamp"):
            return column.cast("string").alias(name)
        return column.cast("double").alias(name) if dtype.startswith("decimal") else column

    return df.select(*[cast(name, dtype) for name, dtype in df.dtypes])


# --- business questions -----------------------------------------------------------------------------------


@query("q1_scorecard")
def q1(t: TestTables) -> DataFrame:
    return kpis.scorecard(
        t.lines(), t.surveys(), t.read("orders").select(money("o_totalprice").alias("gross")),
        stay="stay_days", flag="flag", wait="wait", efficiency="score", score="score", gross="gross",
    )


@query("q4_occupancy")
def q4(t: TestTables) -> DataFrame:
    hops = t.to_department(t.departments())
    return kpis.occupancy(t.lines(), hops, "department", "staffed_beds", F.col("stay_days"))


@query("q5_width_bucket")
def q5_bucket(t: TestTables) -> DataFrame:
    return kpis.rate_by_width_bucket(t.lines(), "score", "flag")


@query("q5_cut")
def q5_cut(t: TestTables) -> DataFrame:
    return kpis.rate_by_cut(t.lines(), "score", "flag")


@query("q6_weekend")
def q6(t: TestTables) -> DataFrame:
    return kpis.wait_by_day_type(t.read("events"), "ts", "value")


@query("q7_margin")
def q7(t: TestTables) -> DataFrame:
    return kpis.margin_by_group(t.lines(), t.to_department(), "department", F.col("gross"), F.col("cost"))


@query("q8_cost_by_type")
def q8(t: TestTables) -> DataFrame:
    return kpis.cost_by_type(t.lines(), t.to_procedure(), "procedure", F.col("gross"))


@query("q9_case")
def q9_case(t: TestTables) -> DataFrame:
    return kpis.score_by_wait_case(t.surveys(), t.documents(), "doc_id", "score", "wait")


@query("q9_cut")
def q9_cut(t: TestTables) -> DataFrame:
    return kpis.score_by_wait_cut(t.surveys(), t.documents(), "doc_id", "score", "wait")


@query("q10_load")
def q10(t: TestTables) -> DataFrame:
    return kpis.load_by_status(t.doctors(), t.read("lineitem"), "doctor_id", "l_suppkey", "employment_status")


@query("x3_group_table")
def x3(t: TestTables) -> DataFrame:
    return kpis.group_table(t.lines(), t.to_department(), "department", F.col("stay_days"), F.col("flag"))


@query("x4_financials")
def x4(t: TestTables) -> DataFrame:
    return kpis.financials(t.lines(), t.to_department(), "department", F.col("gross"), F.col("cost"))


@query("x5_share")
def x5(t: TestTables) -> DataFrame:
    return kpis.count_with_share(t.read("orders").withColumnRenamed("o_orderpriority", "admission_type"), "admission_type")


@query("x6_unknown_mix")
def x6(t: TestTables) -> DataFrame:
    return kpis.mix_with_unknown(t.patients(), "insurance_type")


@query("i1_relative_risk")
def i1(t: TestTables) -> DataFrame:
    bucketed = features.add_bucket(t.lines(), "score")
    return kpis.relative_risk(bucketed, "discharge_efficiency_bucket", "flag", measures.RUSHED, measures.EXCELLENT)


@query("i2_gap_pct")
def i2(t: TestTables) -> DataFrame:
    return kpis.gap_pct(t.read("events"), fn.is_weekend(F.col("ts")), "value")


# --- dashboard measures -----------------------------------------------------------------------------------


@query("t1_measures")
def t1(t: TestTables) -> DataFrame:
    names = ["total_admissions", "avg_length_of_stay", "avg_triage_wait", "avg_satisfaction", "gross_billings"]
    return measures.measures(t.measure_features(), names, ["l_linestatus"])


@query("t2_rate_measure")
def t2(t: TestTables) -> DataFrame:
    return measures.measures(t.measure_features(), ["total_admissions", "readmission_rate_pct"])


@query("t3_margin_fraction")
def t3(t: TestTables) -> DataFrame:
    return measures.measures(t.measure_features(), ["gross_margin", "margin_fraction"], ["l_linestatus"])


@query("t4_bucket_rates")
def t4(t: TestTables) -> DataFrame:
    names = ["rushed_rate_pct", "excellent_rate_pct", "relative_risk"]
    return measures.measures(t.measure_features(), names, ["l_linestatus"])


@query("t1_by_year")
def t1_by_year(t: TestTables) -> DataFrame:
    """Measures sliced by parts of a calendar and a column of a related dimension."""
    names = ["total_admissions", "avg_length_of_stay", "gross_billings", "margin_fraction"]
    return measures.measures(t.dated_measure_features(), names, ["year", "month", "n_regionkey"])


@query("t_cube")
def t_cube(t: TestTables) -> DataFrame:
    """Measures and distinct counts by every subset of the slicers, from one scan of the facts."""
    names = ["total_admissions", "avg_length_of_stay", "gross_billings", "margin_fraction", "readmission_rate_pct"]
    by = ["year", "month", "n_regionkey"]
    return cube.measure_cube(t.dated_measure_features(), names, by, {"doctors": "l_suppkey", "procedures": "l_partkey"})


# --- trends -----------------------------------------------------------------------------------------------


@query("q2_trend_partial")
def q2_partial(t: TestTables) -> DataFrame:
    return trends.monthly_trend(t.read("orders"), "o_orderdate", min_periods=1)


@query("q2_trend_full")
def q2_full(t: TestTables) -> DataFrame:
    return trends.monthly_trend(t.read("orders"), "o_orderdate", min_periods=3)


@query("q2_tail6")
def q2_tail(t: TestTables) -> DataFrame:
    return trends.last_rows(q2_full(t), "admission_month", 6)


@query("q2_incremental")
def q2_incremental(t: TestTables) -> DataFrame:
    """The full-window trend from a monthly state that was filled by two loads, the second one run twice."""
    orders, state = t.read("orders"), scratch(t, "months")
    late = F.col("o_orderkey") % 10 >= 7
    for load, rows in (("first", ~late), ("second", late), ("second", late)):
        trends.add_load(state, orders.where(rows), "o_orderdate", load)
    return trends.trend_of_state(t.spark, state, min_periods=3)


@query("x2_month_label")
def x2(t: TestTables) -> DataFrame:
    return trends.month_labels(t.read("orders"), "o_orderdate")


@query("v1_gapfilled_months")
def v1(t: TestTables) -> DataFrame:
    return trends.gap_filled_months(t.read("lineitem"), "l_shipdate")


@query("t5_calendar_shift")
def t5(t: TestTables) -> DataFrame:
    return trends.calendar_shift_change(t.read("lineitem"), "l_shipdate")


@query("t6_daily_trailing")
def t6(t: TestTables) -> DataFrame:
    return trends.trailing_daily_mean(t.read("lineitem"), "l_shipdate")


@query("t7_calendar")
def t7(t: TestTables) -> DataFrame:
    return trends.calendar_table(t.read("orders"), "o_orderdate")


@query("t7_calendar_span")
def t7_span(t: TestTables) -> DataFrame:
    """A calendar from a given day to the last order."""
    span = t.read("orders").agg(F.lit("1990-01-01").cast("date").alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("b"))
    return trends.calendar_days(span)


# --- outliers and distributions ---------------------------------------------------------------------------


@query("q3_outliers")
def q3(t: TestTables) -> DataFrame:
    return kpis.group_outliers(t.read("events"), "event_type", "value", ["event_id", "event_type", "value"])


@query("q3_top_group")
def q3_top(t: TestTables) -> DataFrame:
    return kpis.outlier_summary(q3(t), "event_type")


@query("v2_box")
def v2(t: TestTables) -> DataFrame:
    return distributions.box_summary(t.read("events"), "event_type", "value")


@query("v3_rate_by_bucket")
def v3(t: TestTables) -> DataFrame:
    return distributions.rate_by_bucket(
        t.lines(), "score", "flag", features.EFFICIENCY_EDGES, features.EFFICIENCY_LABELS
    )


@query("v4_band_mean")
def v4(t: TestTables) -> DataFrame:
    return distributions.band_means(t.surveys(), t.documents(), "doc_id", "score", "wait")


@query("v5_mix")
def v5(t: TestTables) -> DataFrame:
    return distributions.mix_table(t.read("orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("v5_mix_long")
def v5_long(t: TestTables) -> DataFrame:
    return distributions.mix_long(t.read("orders"), "o_orderpriority", "o_orderstatus")


@query("v4_band_mean_wide")
def v4_wide(t: TestTables) -> DataFrame:
    """Both measures on one row, as in the feature table."""
    return distributions.band_means_of(t.lines(), "score", "stay_days")


@query("v6_corr")
def v6(t: TestTables) -> DataFrame:
    return distributions.correlations(t.lines(), [*NUMBERS, "flag"])


@query("d13_describe")
def d13(t: TestTables) -> DataFrame:
    return quality.describe(t.read("lineitem"), NUMBERS, digits=4)


@query("d14_value_counts")
def d14(t: TestTables) -> DataFrame:
    return quality.value_counts(t.read("orders"), "o_orderpriority")


@query("d15_shares")
def d15(t: TestTables) -> DataFrame:
    return quality.value_shares(t.read("labels"), "toxic")


# --- data quality -----------------------------------------------------------------------------------------


@query("j1_dup_keys")
def j1(t: TestTables) -> DataFrame:
    return quality.duplicate_keys(t.read("lineitem"), LINE_KEY)


@query("e5_dup_members")
def e5(t: TestTables) -> DataFrame:
    return quality.duplicate_members(t.read("lineitem").select(*LINE_KEY, *LINE_ORDER), LINE_KEY)


@query("f3_dup_preview")
def f3(t: TestTables) -> DataFrame:
    return quality.preview(e5(t), ROW_KEY, 6)


@query("j2_bad_rows")
def j2(t: TestTables) -> DataFrame:
    return quality.non_positive_rows(t.read("customer"), "c_acctbal", ["c_custkey", "c_acctbal"])


@query("h12_bad_share")
def h12(t: TestTables) -> DataFrame:
    return quality.bad_share(t.read("customer"), F.col("c_acctbal") <= 0)


@query("j3_variants")
def j3(t: TestTables) -> DataFrame:
    return quality.label_variants(t.raw_labels(), "raw_label")


@query("j3_variant_clusters")
def j3_clusters(t: TestTables) -> DataFrame:
    """Spelling variants that no key tells apart, with the canonical spelling of each."""
    return labels.variant_clusters(t.misspelt_labels(), "raw_label")


@query("j9_canonical_spelling")
def j9_spelling(t: TestTables) -> DataFrame:
    return labels.canonical_spelling(t.misspelt_labels(), "raw_label", "label")


@query("j4_missing")
def j4(t: TestTables) -> DataFrame:
    joined = features.add_survey(t.read("documents").select("doc_id", "lang"), t.surveys(), "doc_id", "score")
    return quality.missing_fields(joined, ["satisfaction_score", "lang"])


@query("j5_orphans")
def j5(t: TestTables) -> DataFrame:
    orders = t.read("orders").select("o_orderkey", "o_custkey")
    return quality.orphan_rows(orders, "o_orderkey", t.read("lineitem"), "l_orderkey")


@query("a10_schema_info")
def a10(t: TestTables) -> DataFrame:
    return quality.schema_info(t.patients())


@query("d16_nulls")
def d16(t: TestTables) -> DataFrame:
    return quality.null_counts(t.patients())


@query("j12_rules")
def j12(t: TestTables) -> DataFrame:
    lines = t.lines().select(*ROW_KEY, "stay_days", "wait", "flag", "l_returnflag")
    orders = t.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    dated = join_lookup(lines, orders, "l_orderkey", "left")
    return quality.all_rules(
        quality.row_rules(
            dated,
            {
                "wait is positive": F.col("wait") > 0,
                "shipment follows order": F.col("l_shipdate") >= F.col("o_orderdate"),
                "stay between 1 and 50": F.col("stay_days").between(1, 50),
            },
            domains={"flag is 0 or 1": ("flag", [0, 1]), "return flag is A or N": ("l_returnflag", ["A", "N"])},
        ),
        quality.unique_rule(lines, LINE_KEY, "line key is unique"),
        quality.unique_rule(t.read("orders"), ["o_orderkey"], "order key is unique"),
    )


@query("j11_clean_rules")
def j11(t: TestTables) -> DataFrame:
    """What must hold after repairs: a unique key, positive values, a canonical label on every row."""
    labelled = cleaning.canonical_label(t.raw_labels(), "s_nationkey", t.nation_labels(), "label")
    people = cleaning.impute_group_median(t.read("customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", "c_acctbal")
    kept = cleaning.dedupe_first(t.read("lineitem").select(*ROW_KEY), LINE_KEY, LINE_ORDER)
    return quality.all_rules(
        quality.unique_rule(kept, LINE_KEY, "line key is unique"),
        quality.row_rules(people, {"balance is positive": F.coalesce(F.col("c_acctbal") > 0, F.lit(False))}),
        quality.row_rules(labelled, {"every supplier has a label": F.col("label").isNotNull()}),
    )


@query("j16_constraints")
def j16(t: TestTables) -> DataFrame:
    """Declared constraints as rules: a test that is NULL passes, as in a CHECK."""
    rules = {
        "segment is known": F.col("insurance_type").isin("AUTOMOBILE", "BUILDING", "MACHINERY"),
        "born before 2000": F.col("date_of_birth") < F.lit("2000-01-01").cast("date"),
        "patient is given": F.col("patient_id").isNotNull(),
    }
    return quality.row_rules(t.patients(), rules, null_passes=True)


@query("j17_gate")
def j17(t: TestTables) -> DataFrame:
    """Tables judged in the pass that writes them, and published only if no rule is broken."""
    results = Published(t.spark, scratch(t, "gated"))
    tests = {
        "orders": {"price is positive": F.col("o_totalprice") > 0, "customer is given": F.col("o_custkey").isNotNull()},
        "customer": {"balance is positive": F.col("c_acctbal") > 0, "segment is given": F.col("c_mktsegment").isNotNull()},
    }
    out = None
    for name, rules in tests.items():
        published = F.lit(True)
        try:
            with results.write() as version:
                judged = observed_write(t.read(name), rules, lambda rows, name=name, version=version: version.put(name, rows))
                quality.require(judged)
        except AssertionError:
            published = F.lit(False)
        one = judged.select(F.lit(name).alias("table"), "rule", "violations", "passed", published.alias("published"))
        out = one if out is None else out.unionByName(one)
    return out


@query("j6_profile")
def j6(t: TestTables) -> DataFrame:
    """Schema, missing values and descriptions of one table side by side."""
    people = t.patients()
    profile = quality.schema_info(people).join(quality.null_counts(people), "field")
    figures = quality.describe(people.select("patient_id", F.year("date_of_birth").alias("year_of_birth")), ["patient_id", "year_of_birth"], digits=4)
    return profile.join(figures, "field", "full")


LINKS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("documents", "doc_id", "labels", "doc_id"),
]


@query("j13_fk")
def j13(t: TestTables) -> DataFrame:
    return quality.all_rules(
        *[
            quality.foreign_key_rule(t.read(child), fk, t.read(parent), pk, f"{child}.{fk} -> {parent}.{pk}")
            for child, fk, parent, pk in LINKS
        ]
    )


@query("j13_fk_bitmap")
def j13_bitmap(t: TestTables) -> DataFrame:
    """The same rules by bitmaps of the parent keys: one bitmap for each parent, one scan for each child."""
    bitmaps = {(parent, pk): stored(membership.bitmap(t.read(parent), pk)) for _, _, parent, pk in LINKS}
    by_child: dict[str, dict] = {}
    for child, fk, parent, pk in LINKS:
        by_child.setdefault(child, {})[f"{child}.{fk} -> {parent}.{pk}"] = (fk, bitmaps[parent, pk])
    return quality.all_rules(*[membership.foreign_key_rules(t.read(child), links) for child, links in by_child.items()])


@query("j5_orphans_bitmap")
def j5_bitmap(t: TestTables) -> DataFrame:
    """The rows without a parent, found by the bitmap of the parent keys."""
    orders = t.read("orders").select("o_orderkey", "o_custkey")
    return membership.rows_without_parent(orders, "o_orderkey", stored(membership.bitmap(t.read("lineitem"), "l_orderkey")))


@query("j14_reconcile_keys")
def j14(t: TestTables) -> DataFrame:
    orders = t.read("orders").select(F.col("o_orderkey").alias("key"))
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("key"))
    return quality.reconcile_keys(orders, lines, "key")


@query("j14_drilldown")
def j14_drilldown(t: TestTables) -> DataFrame:
    """Orders missing from, extra in and changed in a second copy, found from the top down."""
    columns = ["o_custkey", "o_orderstatus", "o_totalprice"]
    return reconcile.drilldown(t.read("orders"), t.second_orders(), "o_orderkey", columns)


@query("j15_reconcile_metrics")
def j15(t: TestTables) -> DataFrame:
    """The KPI row taken from the facts against the same figures added up from the department table."""
    direct = t.lines().agg(
        F.count(F.lit(1)).alias("rows"), F.sum("gross").alias("gross"), F.max("l_quantity").alias("peak")
    )
    sums = sums_along(t.lines(), t.to_department(), ["department"], {"rows": F.lit(1), "gross": F.col("gross")})
    rolled = sums.agg(F.sum("rows").alias("rows"), F.sum("gross").alias("gross"), F.max("rows").alias("peak"))
    return quality.reconcile_metrics(direct, rolled, ["rows", "gross", "peak"])


@query("j7_removed")
def j7_removed(t: TestTables) -> DataFrame:
    return quality.surplus_rows(t.read("lineitem"), LINE_KEY)


# --- cleaning ---------------------------------------------------------------------------------------------


@query("j7_dedupe_first")
def j7(t: TestTables) -> DataFrame:
    return cleaning.dedupe_first(t.read("lineitem").select(*ROW_KEY, "l_quantity"), LINE_KEY, LINE_ORDER)


@query("j8_impute_median")
def j8(t: TestTables) -> DataFrame:
    people = t.read("customer").select("c_custkey", "c_nationkey", "c_acctbal")
    repaired = cleaning.impute_group_median(people, "c_nationkey", "c_acctbal")
    return repaired.withColumn("c_acctbal", fn.half_up(F.col("c_acctbal"), 4))


@query("j9_canonical")
def j9(t: TestTables) -> DataFrame:
    labelled = cleaning.canonical_label(t.raw_labels(), "s_nationkey", t.nation_labels(), "label")
    return cleaning.split_audit(labelled, "raw_label", [])[0]


@query("j9_audit")
def j9_audit(t: TestTables) -> DataFrame:
    labelled = cleaning.canonical_label(t.raw_labels(), "s_nationkey", t.nation_labels(), "label")
    return cleaning.split_audit(labelled, "raw_label", ["s_suppkey", "s_nationkey", "label"])[1]


@query("j10_iqr_clip")
def j10(t: TestTables) -> DataFrame:
    events = t.read("events").select("event_id", "value", F.col("user_id").cast("double").alias("user_id"))
    clipped = cleaning.iqr_clip(events, ["value", "user_id"])
    return clipped.withColumn("value", fn.half_up(F.col("value"), 4))


@query("j10_clip_counts")
def j10_counts(t: TestTables) -> DataFrame:
    counts = cleaning.clip_counts(t.read("events"), ["value", "user_id"])
    return counts.withColumns({c: fn.half_up(F.col(c), 4) for c in ("low", "high")})


# --- sources and sinks: what was written and read again must equal the table -----------------------------


def tables_of(ddl: str) -> list[str]:
    """Column names of a DDL schema."""
    return StructType.fromDDL(ddl).fieldNames()


def scratch(t: TestTables, name: str) -> str:
    """A new path in the run's folder, which is removed with it."""
    return f"{run_path(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("a_csv_roundtrip")
def a_csv(t: TestTables) -> DataFrame:
    """Typed values, text with quotes and commas, and a renamed column through CSV."""
    orders = t.read("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", F.concat(F.lit('a, "b" '), "o_orderpriority").alias("note"))
    path = scratch(t, "csv")
    tables.write_csv(orders, path)
    return tables.read_csv(t.spark, path, orders.schema, {"note": "priority_note"})


@query("a_json_roundtrip")
def a_json(t: TestTables) -> DataFrame:
    """A named result with NULLs as a JSON dataset."""
    path = scratch(t, "json")
    tables.write_results({"patients": t.patients()}, path)
    return tables.read_result(t.spark, path, "patients", t.patients().schema)


@query("a5_json_document")
def a5_document(t: TestTables) -> DataFrame:
    """Rows of a list inside JSON objects; an object holds a nation's suppliers in a range of 10,000 keys."""
    part = F.floor(F.col("s_suppkey") / 10_000).alias("part")
    nested = t.read("supplier").groupBy("s_nationkey", part).agg(F.collect_list(F.struct("s_suppkey", "s_acctbal")).alias("suppliers"))
    path = scratch(t, "document")
    nested.write.partitionBy("s_nationkey", "part").json(path)
    return tables.read_document(t.spark, path, "suppliers", nested.schema)


ORDER_LINE = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date"


@query("a1_quarantine")
def a1_quarantine(t: TestTables) -> DataFrame:
    """Orders as text lines, some of them broken: the good rows, and the bad ones with their reasons."""
    key, cells = F.col("o_orderkey"), [F.col("o_orderkey"), F.col("o_custkey"), F.concat(F.lit('"a, '), "o_orderstatus", F.lit('"')), F.col("o_totalprice")]
    cells = [*[c.cast("string") for c in cells], F.date_format("o_orderdate", "yyyy-MM-dd")]
    line = F.concat_ws(",", *cells)
    price, customer = [*cells], [*cells]
    price[3], customer[1] = F.lit("n/a"), F.lit("")
    broken = (
        F.when(key % 50 == 1, F.concat_ws(",", *price)).when(key % 50 == 2, F.concat_ws(",", *cells[:4])).when(key % 50 == 3, F.concat(line, F.lit(",x")))
        .when(key % 50 == 4, F.concat_ws(",", *customer)).when(key % 50 == 5, F.concat(F.concat_ws(",", *price), F.lit("-"))).otherwise(line)
    )
    path = scratch(t, "lines")
    t.read("orders").select(broken.alias("value")).write.text(path)
    load = read_with_quarantine(t.spark, path, ORDER_LINE, ["o_orderkey", "o_custkey"], header=False)
    bad = load.bad.select(F.split("raw", ",")[0].cast("long").alias("o_orderkey"), F.array_join("reasons", "; ").alias("outcome"))
    return load.good.select(*tables_of(ORDER_LINE), F.lit("good").alias("outcome")).unionByName(bad, allowMissingColumns=True)


@query("a6_publish")
def a6_publish(t: TestTables) -> DataFrame:
    """Two results published together, then a run that fails half-way: readers still find the first version."""
    results = Published(t.spark, scratch(t, "published"))
    with results.write() as version:
        version.put("nations", t.read("nation"))
        version.put("customers", t.read("customer"))
    try:
        with results.write() as version:
            version.put("nations", t.read("nation").limit(0))
            raise InterruptedError("the run was killed")
    except InterruptedError:
        pass
    both = results.read("customers").join(results.read("nations"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.sum(money("c_acctbal")).alias("balance"))


@query("a_table_roundtrip")
def a_table(t: TestTables) -> DataFrame:
    """A partitioned parquet table."""
    path = scratch(t, "table")
    tables.write_table(t.read("lineitem").select(*LINE_KEY, "l_quantity", "l_linestatus"), path, ["l_linestatus"])
    return tables.read_table(t.spark, path)


@query("a3_sql_scan")
def a3(t: TestTables) -> DataFrame:
    """SQL text over named frames."""
    text = "SELECT n_name, count(*) AS suppliers, sum(cast(s_acctbal AS decimal(12,2))) AS balance FROM suppliers JOIN nations ON s_nationkey = n_nationkey GROUP BY n_name"
    return tables.read_sql(t.spark, text, {"suppliers": t.read("supplier"), "nations": t.read("nation")})


@query("a2_moments")
def a2(t: TestTables) -> DataFrame:
    """Text columns parsed as timestamps without a zone."""
    texts = t.read("events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    return tables.parse_moments(texts, ["ts"])


# --- features ---------------------------------------------------------------------------------------------


@query("k1_age_band")
def k1(t: TestTables) -> DataFrame:
    orders = t.read("orders").select("o_orderkey", F.col("o_custkey").alias("patient_id"), "o_orderdate")
    return features.add_age(orders, t.patients(), "patient_id", "date_of_birth", "o_orderdate").drop("o_orderdate")


@query("k2_calendar")
def k2(t: TestTables) -> DataFrame:
    return features.add_calendar(t.read("orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("k3_children")
def k3(t: TestTables) -> DataFrame:
    orders = t.read("orders").select(F.col("o_orderkey").alias("admission_id"))
    return features.add_children(orders, t.treatments(), "admission_id", "treatment_id", "treatment_cost")


@query("k4_finance")
def k4(t: TestTables) -> DataFrame:
    stays = t.read("orders").select(
        F.col("o_orderkey").alias("admission_id"), F.floor(F.col("o_totalprice") / 25000).alias("stay")
    )
    return features.add_finance(stays, t.billing(), "admission_id", "gross_charge", "direct_operating_cost", "stay")


@query("k5_survey")
def k5(t: TestTables) -> DataFrame:
    return features.add_survey(t.read("documents").select("doc_id"), t.surveys(), "doc_id", "score")


@query("d24_response_rate")
def d24(t: TestTables) -> DataFrame:
    return features.response_rate(k5(t), "satisfaction_score")


@query("k6_bucket")
def k6(t: TestTables) -> DataFrame:
    bucketed = features.add_bucket(t.lines(), "score")
    return quality.value_counts(bucketed, "discharge_efficiency_bucket", dropna=False)


@query("k7_features")
def k7(t: TestTables) -> DataFrame:
    return features.feature_table(t.admissions(), t.patients(), t.treatments(), t.billing(), t.order_surveys())


@query("k7_bucketed")
def k7_bucketed(t: TestTables) -> DataFrame:
    """The same features from tables kept in buckets of the stay's key: the rows are joined where they lie."""
    names = {}
    for name, frame, key in (("admissions", t.admissions(), "admission_id"), ("treatments", t.treatments(), "admission_id"),
                             ("billing", t.billing(), "admission_id"), ("surveys", t.order_surveys(), "admission_id")):
        table = f"{name}_{uuid.uuid4().hex}"
        names[name] = tables.write_bucketed(frame, table, scratch(t, table), key, BUCKETS)
    return features.feature_table(names["admissions"], t.patients(), names["treatments"], names["billing"], names["surveys"])


# --- table operators --------------------------------------------------------------------------------------


@query("r1_hash_sample")
def r1(t: TestTables) -> DataFrame:
    return sampling.hash_sample(t.read("orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 0.012)


@query("r2_add_days")
def r2(t: TestTables) -> DataFrame:
    stay = F.col("o_totalprice") / 12345
    return t.read("orders").select("o_orderkey", fn.add_days(F.col("o_orderdate"), stay).alias("discharge_date"))


@query("r3_logistic")
def r3(t: TestTables) -> DataFrame:
    linear = F.lit(-3.85) + (100 - F.col("o_totalprice") / 5000) * 0.028 + (F.col("o_totalprice") / 50000) * 0.18
    return t.read("orders").select("o_orderkey", fn.half_up(fn.logistic(linear), 6).alias("risk"))


@query("r4_season_factor")
def r4(t: TestTables) -> DataFrame:
    by_month = {12: 1.35, 1: 1.4, 2: 1.25, 7: 0.85, 8: 0.85}
    factor = fn.calendar_factor(F.col("o_orderdate"), by_month, weekend=1.15)
    return t.read("orders").select("o_orderkey", fn.half_up(factor, 6).alias("factor"))


@query("g2_union_all")
def g2(t: TestTables) -> DataFrame:
    people = t.read("customer").select("c_custkey", "c_mktsegment")
    return people.unionByName(sampling.hash_sample(people, ["c_custkey"], 0.012))


@query("h11_labels")
def h11(t: TestTables) -> DataFrame:
    sums = kpis.count_with_share(t.read("orders"), "o_orderpriority", "orders").select("o_orderpriority", "orders")
    money_by = t.read("orders").groupBy("o_orderpriority").agg(F.sum(money("o_totalprice")).alias("gross"))
    return sums.join(money_by, "o_orderpriority").select(
        "o_orderpriority",
        fn.thousands_label(F.col("orders")).alias("orders_label"),
        fn.millions_label(F.col("gross")).alias("gross_label"),
    )


# --- model ------------------------------------------------------------------------------------------------


@query("m2_split")
def m2(t: TestTables) -> DataFrame:
    return sampling.stratified_split(t.lines().select("flag", *ROW_KEY), "flag", ROW_KEY)


@query("m1_inputs")
def m1(t: TestTables) -> DataFrame:
    """Inputs of the model: numbers as doubles, a missing category as a value of its own."""
    rows = t.patients().withColumn("readmitted", (F.col("patient_id") % 2).cast("int"))
    return model.model_frame(rows, ["insurance_type"], ["patient_id"], "readmitted")


@query("m3_categories")
def m3(t: TestTables) -> DataFrame:
    """The categories of each field with the index that the encoder gives them, most frequent first."""
    return model.category_indices(t.model_features(), MODEL_CATEGORIES)


@query("m6_called")
def m6(t: TestTables) -> DataFrame:
    """A score against several thresholds: rows called positive and those of them that are."""
    return model.threshold_counts(t.scored(), "flag", "score", [0.1, 0.25, 0.5, 0.75])


@query("m5_weights")
def m5(t: TestTables) -> DataFrame:
    return model.class_weights(t.lines(), "flag")


@query("m7_auc")
def m7(t: TestTables) -> DataFrame:
    return model.roc_auc(t.scored(), "flag", "score")


@query("m8_report")
def m8(t: TestTables) -> DataFrame:
    return model.classification_report(t.scored(), "flag", "predicted")


@query("m9_roc")
def m9(t: TestTables) -> DataFrame:
    return model.roc_points(t.scored(), "flag", "score")


#: The model of a session's tables, fitted once for all queries that read it.
_MODELS: dict[tuple, tuple] = {}


def _fitted(t: TestTables):
    """Model fitted on the exact split, with the training and the held-out rows."""
    key = (t.spark.sparkContext.applicationId, run_name(), t.folder)
    if key not in _MODELS:
        split = spread(sampling.stratified_split(t.model_features(), "readmitted", ROW_KEY))
        train, test = (split.where(F.col("split") == part) for part in ("train", "test"))
        inputs = partial(model.model_frame, categorical=MODEL_CATEGORIES, numeric=MODEL_NUMBERS, label="readmitted")
        train, test = inputs(train), inputs(test)
        fitted = model.train_forest(train, MODEL_CATEGORIES, MODEL_NUMBERS, "readmitted")
        scored = stored(model.score(fitted, test).select("readmitted", "score", "predicted"))
        _MODELS[key] = fitted, train, scored
    return _MODELS[key]


@query("m4_forest")
def m4(t: TestTables) -> DataFrame:
    """Held-out rows scored by the forest: exact support per class, and whether scores and report are in their bounds."""
    report = m4_report(t)
    in_bounds = F.col("precision").between(0, 1) & F.col("recall").between(0, 1) & F.col("f1").between(0, 1)
    return report.select("row", "support", in_bounds.alias("in_bounds"))


@query("m4_report")
def m4_report(t: TestTables) -> DataFrame:
    """Precision, recall and F1 of the forest on the held-out rows."""
    _, _, scored = _fitted(t)
    return model.classification_report(scored, "readmitted", "predicted")


@query("m4_auc")
def m4_auc(t: TestTables) -> DataFrame:
    """Area under the ROC curve of the forest on the held-out rows."""
    _, _, scored = _fitted(t)
    return model.roc_auc(scored, "readmitted", "score")


@query("m10_importances")
def m10(t: TestTables) -> DataFrame:
    """Every encoded feature of the forest by name, and whether the importances are shares of one."""
    found = m10_shares(t)
    total = found.agg(F.sum("importance")).scalar()
    return found.select("feature", (F.col("importance").between(0, 1) & (F.abs(total - 1) < 1e-6)).alias("is_share"))


@query("m10_shares")
def m10_shares(t: TestTables) -> DataFrame:
    """Importance of every encoded feature of the forest, highest first."""
    fitted, train, _ = _fitted(t)
    return model.importances(fitted, train)
