"""Readers and writers around Spark's own sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opslens.sources.schemas import SCHEMAS


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str, renames: Mapping[str, str] | None = None
) -> DataFrame:
    """CSV with a header row and a declared schema; a malformed row fails the read, so none is lost silently."""
    frame = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return frame.withColumnsRenamed(dict(renames or {}))


def read_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All operational tables of a folder of ``<table>.csv`` files (or folders of part files)."""
    return {name: read_csv(spark, f"{folder}/{name}.csv", schema) for name, schema in SCHEMAS.items()}


def parse_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns to timestamps without a zone."""
    return df.withColumns({c: F.to_timestamp_ntz(c) for c in columns})


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet table; fails when it is already there."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Catalog table in hash buckets of ``key``, sorted by it.

    Tables in the same number of buckets of a common key are joined on it, and grouped by it, without a shuffle.
    Choose ``buckets`` so that one holds about 128 MB to 1 GB.
    """
    writer = df.repartition(buckets, key).write.mode("errorifexists").bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_results(results: Mapping[str, DataFrame], folder: str) -> None:
    """One JSON dataset per named result, NULLs included."""
    for name, frame in results.items():
        frame.write.mode("errorifexists").option("ignoreNullFields", False).json(f"{folder}/{name}")


def read_result(spark: SparkSession, folder: str, name: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(f"{folder}/{name}")


def read_document(spark: SparkSession, path: str, field: str, schema: StructType | str | None = None) -> DataFrame:
    """Sub-document ``field`` of a JSON file that holds one object, as columns; a list becomes one row per item."""
    reader = spark.read.option("multiLine", True)
    document = (reader.schema(schema) if schema else reader).json(path)
    kind = dict(document.dtypes)[field]
    if kind.startswith("array"):
        return document.select(F.explode(F.col(field)).alias("item")).select("item.*")
    return document.select(f"{field}.*") if kind.startswith("struct") else document.select(field)


def read_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Run SQL text over named frames."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
    return spark.sql(text)


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Relational table, read in key ranges in parallel."""
    return spark.read.jdbc(
        url, table, column=key, lowerBound=low, upperBound=high, numPartitions=partitions, properties=dict(properties or {})
    )
