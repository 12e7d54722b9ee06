"""Run registered queries on Spark and their SQL on DuckDB, and compare whole results.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, Decimal):
        return f"{value:f}"
    if isinstance(value, (list, tuple)):
        return str([cell(v) for v in value])
    return str(value)


def connect(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in rows)


def difference(spark, sf_dir: str, name: str, function, sql: str, connection) -> str | None:
    """None when equal, else a short description."""
    df = function(spark, sf_dir)
    got_columns, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    want_columns, want = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got != want:
        extra, missing = got - want, want - got
        return f"rows {sum(got.values())} vs {sum(want.values())}; extra {list(extra)[:2]} missing {list(missing)[:2]}"
    if not got:
        return "EMPTY"
    return None


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rowsmith")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, connection = session(), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                result = difference(spark, sf_dir, name, queries[name], oracles[name], connection)
            else:
                result = None if queries[name](spark, sf_dir).count() else "EMPTY"
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:600]}"
        bad += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - start:.2f}s {'' if name in oracles else '(rows)'} {result or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")


if __name__ == "__main__":
    main()
