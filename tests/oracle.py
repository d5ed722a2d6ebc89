"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()

DUCKDB_TYPES = {"int": "integer", "string": "varchar"}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(str(_plain(row[i])) for i in order) for row in rows))


def compare(spark, con, name, function, sql, sf_dir):
    """(message or None, seconds in Spark, rows)."""
    start = time.time()
    frame = function(spark, sf_dir)
    found = [tuple(r) for r in frame.collect()]
    seconds = time.time() - start
    if sql is None:
        return None, seconds, len(found)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}", seconds, len(found)
    wanted_types = {r[0]: r[1].lower() for r in con.execute(f"describe {sql}").fetchall()}
    types = {n: DUCKDB_TYPES.get(t, t) for n, t in frame.dtypes}
    if types != wanted_types:
        return f"types {types} != {wanted_types}", seconds, len(found)
    left, right = _rows(frame.columns, found), _rows(names, expected)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}", seconds, len(found)
    for a, b in zip(left, right):
        if a != b:
            return f"values differ:\n  spark {str(a)[:600]}\n  sql   {str(b)[:600]}", seconds, len(found)
    return None, seconds, len(found)


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for key, function in entry.queries().items():
        if wanted and key not in wanted:
            continue
        try:
            message, seconds, n = compare(session, con, key, function, entry.oracle_sql().get(key), sf_dir)
        except Exception as error:  # report and go on
            message, seconds, n = f"{type(error).__name__}: {str(error)[:700]}", 0, 0
        bad += message is not None
        print(f"{key:28s} {seconds:6.2f}s {n:7d} {'ok' if message is None else message}", flush=True)
    print("bad:", bad)
    sys.exit(bad > 0)
