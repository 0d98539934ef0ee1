"""Runs the registered queries against DuckDB on the same tables and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return str(value)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(spark_df, con: duckdb.DuckDBPyConnection, text: str) -> str:
    """Empty when equal, else what differs."""
    got = spark_df.collect()
    relation = con.sql(text)
    if sorted(spark_df.columns) != sorted(relation.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(relation.columns)}"
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    for name, dtype in spark_df.dtypes:
        expected = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        if expected.get(dtype) != kinds[name]:
            return f"type of {name}: {dtype} != {kinds[name]}"
    left, right = rows_of(spark_df.columns, got), rows_of(relation.columns, relation.fetchall())
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    different = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(different)} of {len(left)} rows differ, first {different[0]}" if different else ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from opslens.session import local_session

    folder = sys.argv[1]
    only = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    texts = entry.oracle_sql()
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            result = compare(run(spark, folder), con, texts[name]) if name in texts else f"rows {run(spark, folder).count()}"
        except Exception as error:  # report and go on with the next query
            result = f"ERROR {type(error).__name__} {str(error)[:600]}"
        print(f"{name:24s} {time.time() - start:6.2f}s {result or 'ok'}", flush=True)
