"""Run every registered query and compare it with its SQL twin in DuckDB."""

from __future__ import annotations

import decimal
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cores="8"):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cores}]").appName("docflow")
             .config("spark.sql.shuffle.partitions", cores).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


TIMES: dict[str, float] = {}


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


def row_set(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def spark_rows(df):
    return row_set(df.columns, df.collect())


def duck_rows(sql, folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS FROM '{folder}/{name}.parquet'")
    con.execute(sql)
    return row_set([d[0] for d in con.description], con.fetchall())


def compare(spark, name, folder):
    """None when the rows agree, otherwise what differs."""
    import __spark_entry__ as entry

    start = time.time()
    columns, rows = spark_rows(entry.queries()[name](spark, folder))
    TIMES[name] = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if rows else "no rows"
    expected_columns, expected = duck_rows(sql, folder)
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if rows != expected:
        here, there = set(rows) - set(expected), set(expected) - set(rows)
        return f"{len(rows)} rows != {len(expected)}; spark {sorted(here)[:2]} sql {sorted(there)[:2]}"[:1500]
    return None if rows else "no rows on either side"


if __name__ == "__main__":
    import __spark_entry__ as entry

    spark = session(__import__("os").environ.get("TEST_CPUS", "8"))
    folder = sys.argv[1]
    failed = 0
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            problem = compare(spark, name, folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failed += problem is not None
        kind = "sql " if name in entry.oracle_sql() else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {TIMES.get(name, 0):6.2f}s of {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print("failed:", failed)
