"""CSV loads that survive malformed rows.

The file is read once, in permissive mode, and every row lands in one of two stored tables: the good rows in their
declared types, or the bad ones as raw text with the reasons. Their numbers add up to the rows of the file.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from opslens.session import stored

RAW = "_corrupt_record"


@dataclass(frozen=True)
class Load:
    """``good`` rows, and ``bad`` ones as ``raw, reasons``."""

    good: DataFrame
    bad: DataFrame

    def counts(self) -> DataFrame:
        """Rows by outcome: one row for the good ones and one for each combination of reasons."""
        good = self.good.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("good").alias("outcome"), "n_rows")
        bad = self.bad.groupBy(F.array_join("reasons", "; ").alias("outcome")).agg(F.count(F.lit(1)).alias("n_rows"))
        return good.unionByName(bad)


#: A quoted value, in which a delimiter is text.
_QUOTED = r'"(?:[^"\\\\]|\\\\.|"")*"'


def _reasons(schema: StructType, required: Sequence[str]) -> Column:
    """Why a raw row does not fit: its number of fields, values that are not of their type, required values that are not there."""
    count = F.col("_count")
    found = [
        F.when(count < len(schema), F.lit("too few fields")),
        F.when(count > len(schema), F.lit("too many fields")),
    ]
    for i, f in enumerate(schema):
        text = F.get("_fields", F.lit(i))
        if not isinstance(f.dataType, StringType):
            found.append(F.when(text.isNotNull() & text.try_cast(f.dataType).isNull(), F.lit(f"{f.name} is not {f.dataType.simpleString()}")))
        if f.name in required:
            found.append(F.when((count > i) & text.isNull(), F.lit(f"{f.name} is missing")))
    reasons = F.array_compact(F.array(*found))
    return F.when(F.size(reasons) == 0, F.array(F.lit("malformed"))).otherwise(reasons)


def read_with_quarantine(
    spark: SparkSession, path: str, schema: StructType | str, required: Sequence[str] = (), header: bool = True
) -> Load:
    """Rows of CSV files, a line each, parted into those that fit ``schema`` and those that do not.

    A row is bad if it has more or fewer fields, a value that is not of its type, or no value in a ``required`` column.
    All columns are read, because a malformed value in a column that is pruned would go unnoticed.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.fieldNames()
    whole = StructType([*[StructField(f.name, f.dataType) for f in schema], StructField(RAW, StringType())])
    reader = spark.read.schema(whole).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW)
    lacking = F.lit(False)
    for name in required:
        lacking = lacking | F.col(name).isNull()
    # what only lacks a required value is not malformed for the parser; its line is made again from its values
    line = F.coalesce(F.col(RAW), F.when(lacking, F.to_csv(F.struct(*names))))
    rows = stored(reader.csv(path).withColumn(RAW, line))
    good = rows.where(F.col(RAW).isNull()).select(*names)
    texts = [f"f{i}" for i in range(len(schema))]
    parsed = F.from_csv(F.col(RAW), ", ".join(f"{n} string" for n in texts), {"mode": "PERMISSIVE"})
    open_text = F.regexp_replace(RAW, _QUOTED, "")
    count = F.length(open_text) - F.length(F.replace(open_text, F.lit(","), F.lit(""))) + 1
    broken = rows.where(F.col(RAW).isNotNull()).select(F.col(RAW).alias("raw"), parsed.alias("_parsed"), count.alias("_count"))
    broken = broken.withColumn("_fields", F.array(*[F.col(f"_parsed.{n}") for n in texts]))
    return Load(good, stored(broken.select("raw", _reasons(schema, required).alias("reasons"))))
