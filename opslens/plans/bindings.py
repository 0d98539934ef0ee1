"""Roles of the operations model, taken from the TPC-H-like test tables.

Money is cast to decimals, as in the operational schema: its sums are exact and do not depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions.scalar import clamp
from opslens.operators.features import add_bucket
from opslens.operators.joins import join_lookup
from opslens.operators.rollups import Hop


def money(column: str) -> Column:
    return F.col(column).cast("decimal(12,2)")


@dataclass(frozen=True)
class TestTables:
    """The test tables of one folder, and the role frames built from them."""

    __test__ = False

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # Line items as stays: price is the gross charge, the discounted price the cost, the discount the score.

    def lines(self) -> DataFrame:
        gross, discount = money("l_extendedprice"), F.col("l_discount").cast("decimal(4,2)")
        return self.read("lineitem").withColumns(
            {
                "stay_days": F.col("l_quantity"),
                "gross": gross,
                "cost": gross * (F.lit(1).cast("decimal(1,0)") - discount),
                "score": F.rint(F.col("l_discount") * 100) * 10,
                "flag": (F.col("l_returnflag") == "R").cast("int"),
                "wait": F.rint(F.col("l_tax") * 100) * 10,
            }
        )

    def departments(self) -> DataFrame:
        """Nations with the number of their suppliers as capacity."""
        counts = self.read("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
            F.count(F.lit(1)).alias("staffed_beds")
        )
        joined = self.read("nation").join(counts, "n_nationkey", "left")
        return joined.select(
            "n_nationkey", F.col("n_name").alias("department"), F.coalesce("staffed_beds", F.lit(0)).alias("staffed_beds")
        )

    def to_department(self, departments: DataFrame | None = None) -> list[Hop]:
        """From line items over their supplier to the nation."""
        nations = departments or self.read("nation").withColumnRenamed("n_name", "department")
        keep = [c for c in ("department", "staffed_beds") if c in nations.columns]
        return [
            Hop("l_suppkey", self.read("supplier"), "s_suppkey", ["s_nationkey"]),
            Hop("s_nationkey", nations, "n_nationkey", keep),
        ]

    def to_procedure(self) -> list[Hop]:
        parts = self.read("part").select("p_partkey", F.col("p_type").alias("procedure"))
        return [Hop("l_partkey", parts, "p_partkey", ["procedure"])]

    def doctors(self) -> DataFrame:
        balance = F.col("s_acctbal")
        status = F.when(balance < 0, "Contract").when(balance < 3000, "Part-Time").otherwise("Full-Time")
        return self.read("supplier").select(F.col("s_suppkey").alias("doctor_id"), status.alias("employment_status"))

    def patients(self) -> DataFrame:
        """Customers; an overdrawn one has no segment, and the balance shifts the date of birth."""
        balance = F.col("c_acctbal")
        return self.read("customer").select(
            F.col("c_custkey").alias("patient_id"),
            F.when(balance >= 0, F.col("c_mktsegment")).alias("insurance_type"),
            F.date_sub(F.lit("1998-01-01").cast("date"), F.floor(balance * 3).cast("int")).alias("date_of_birth"),
        )

    def surveys(self) -> DataFrame:
        """Labels as survey answers about documents."""
        return self.read("labels").select(
            "doc_id", (F.col("quality") * 60 + F.col("toxic") * 25 + F.col("doc_id") / 1000.0).alias("score")
        )

    def documents(self) -> DataFrame:
        return self.read("documents").select("doc_id", (F.col("n_chars") / 100.0).alias("wait"))

    # Orders as stays, in the column names of the operational schema.

    def admissions(self) -> DataFrame:
        price = F.col("o_totalprice")
        stays = self.read("orders").select(
            F.col("o_orderkey").alias("admission_id"),
            F.col("o_custkey").alias("patient_id"),
            F.col("o_orderdate").alias("admission_date"),
            F.col("o_orderpriority").alias("admission_type"),
            F.round(price / 50000, 1).alias("severity_score"),
            F.floor(price / 25000).cast("double").alias("length_of_stay_days"),
            (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) / 40.0).alias("wait_minutes"),
            F.round(price / 5000, 1).alias("discharge_efficiency"),
            (F.col("o_orderstatus") == "F").cast("int").alias("readmitted_30d"),
        )
        people = self.read("customer").select(
            F.col("c_custkey").alias("patient_id"), F.col("c_nationkey").alias("department_id")
        )
        nations = self.read("nation").select(
            F.col("n_nationkey").alias("department_id"), F.col("n_name").alias("department")
        )
        return join_lookup(join_lookup(stays, people, "patient_id", "left"), nations, "department_id", "left")

    def treatments(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("admission_id"),
            F.col("l_linenumber").alias("treatment_id"),
            money("l_extendedprice").alias("treatment_cost"),
        )

    def billing(self) -> DataFrame:
        """One bill per order."""
        return self.lines().groupBy(F.col("l_orderkey").alias("admission_id")).agg(
            F.sum("gross").alias("gross_charge"), F.sum("cost").alias("direct_operating_cost")
        )

    def order_surveys(self) -> DataFrame:
        return self.surveys().select(F.col("doc_id").alias("admission_id"), F.col("score").alias("satisfaction_score"))

    def second_orders(self) -> DataFrame:
        """A copy of the orders in which some are missing, some have another price, and some are new."""
        orders = self.read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
        key = F.col("o_orderkey")
        changed = F.when(key % 1009 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
        kept = orders.where(key % 997 != 5).withColumn("o_totalprice", changed)
        new = self.read("customer").where(F.col("c_custkey") % 101 == 7).select(
            (F.col("c_custkey") * 1000 + 10**9).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"),
            F.lit("O").alias("o_orderstatus"), F.col("c_acctbal").alias("o_totalprice"),
        )
        return kept.unionByName(new)

    # Raw labels and scores.

    def raw_labels(self) -> DataFrame:
        """Suppliers with a raw nation label that is lower-case on odd keys."""
        nations = self.read("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
        joined = join_lookup(self.read("supplier").select("s_suppkey", "s_nationkey"), nations, "s_nationkey")
        odd = F.col("s_suppkey") % 2 == 1
        raw = F.when(odd, F.lower("n_name")).otherwise(F.col("n_name"))
        return joined.select("s_suppkey", "s_nationkey", raw.alias("raw_label"))

    def misspelt_labels(self) -> DataFrame:
        """Customers with a label of their segment and nation, a part of them with a slip in its letters."""
        people = self.read("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
        joined = join_lookup(people, self.read("nation").select("n_nationkey", "n_name"), "n_nationkey")
        label = F.concat("c_mktsegment", F.lit(" "), "n_name")
        rest = lambda start: F.substr(label, F.lit(start), F.lit(100))
        part = lambda start, n: F.substr(label, F.lit(start), F.lit(n))
        slips = [
            F.lower(label), F.concat(part(1, 2), rest(4)), F.concat(part(1, 4), part(4, 1), rest(5)), F.concat(part(1, 1), part(3, 1), part(2, 1), rest(4)),
            F.concat(part(1, 4), F.lit("x"), rest(6)), F.concat(label, F.lit(" .")), F.replace(label, F.lit(" "), F.lit("-")),
        ]
        kind = F.col("c_custkey") % 16
        raw = label
        for i, slip in enumerate(slips):
            raw = F.when(kind == i, slip).otherwise(raw)
        return joined.select("c_custkey", raw.alias("raw_label"))

    def nation_labels(self) -> DataFrame:
        return self.read("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("label"))

    def scored(self) -> DataFrame:
        """Line items with a fixed risk score in (0, 1), rounded so that both engines agree on ties."""
        linear = F.col("l_quantity") * 0.04 - F.col("l_discount") * 20
        risk = F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))
        score = F.round(risk.cast("decimal(38,10)"), 4).cast("double")
        return self.lines().select("flag", score.alias("score")).withColumn(
            "predicted", (F.col("score") >= 0.5).cast("int")
        )

    def measure_features(self) -> DataFrame:
        """Line items under the names the dashboard measures use."""
        score = F.col("score")
        return add_bucket(self.lines(), "score").select(
            "l_linestatus",
            F.col("stay_days").alias("length_of_stay_days"),
            F.col("wait").alias("wait_minutes"),
            F.when(F.col("wait") > 0, clamp(score, F.lit(0.0), F.lit(90.0))).alias("satisfaction_score"),
            F.col("flag").alias("readmitted_30d"),
            "discharge_efficiency_bucket",
            F.col("gross").alias("gross_charge"),
            (F.col("gross") - F.col("cost")).alias("margin"),
        )

    def dated_measure_features(self) -> DataFrame:
        """The measures' columns next to the parts of the ship date and the supplier's region."""
        date = F.col("l_shipdate")
        lines = self.lines().select(
            "l_suppkey", "l_partkey", F.year(date).alias("year"), F.month(date).alias("month"), F.col("stay_days").alias("length_of_stay_days"),
            F.col("gross").alias("gross_charge"), (F.col("gross") - F.col("cost")).alias("margin"),
            F.lit(None).cast("double").alias("wait_minutes"), F.lit(None).cast("double").alias("satisfaction_score"),
            F.col("flag").alias("readmitted_30d"), F.lit(None).cast("string").alias("discharge_efficiency_bucket"),
        )
        nations = self.read("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
        regions = join_lookup(self.read("supplier").select("s_suppkey", "s_nationkey"), nations, "s_nationkey")
        return join_lookup(lines, regions.select(F.col("s_suppkey").alias("l_suppkey"), "n_regionkey"), "l_suppkey")

    def model_features(self) -> DataFrame:
        """Line items with their part: inputs of the risk model, the target, and a row key."""
        parts = self.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand", "p_size", "p_retailprice")
        joined = join_lookup(self.read("lineitem"), parts, "l_partkey")
        return joined.withColumn("readmitted", (F.col("l_returnflag") == "R").cast("int"))
