"""Run registered queries against their SQL on the same tables."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is None, type(v).__name__, str(v)) for v in row)


def _norm(value):
    if isinstance(value, float):
        return float(repr(value))
    return value


def compare(spark, con, name, fn, sql, sf_dir) -> str:
    """'' when rows, column names and values agree."""
    df = fn(spark, sf_dir)
    columns = sorted(df.columns)
    left = sorted((tuple(_norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=_key)
    if sql is None:
        return "" if left else "no rows"
    cursor = con.execute(sql)
    have = [c[0] for c in cursor.description]
    if sorted(have) != columns:
        return f"columns {columns} against {sorted(have)}"
    order = [have.index(c) for c in columns]
    right = sorted((tuple(_norm(r[i]) for i in order) for r in cursor.fetchall()), key=_key)
    if len(left) != len(right):
        extra = [r for r in left[:2000] if r not in set(right)][:2] if left and not _unhashable(right) else []
        return f"{len(left)} rows against {len(right)}; only left {extra}"
    for a, b in zip(left, right):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"differs: {columns}\n  {str(a)[:600]}\n  {str(b)[:600]}"
    if not left:
        return "no rows"
    return ""


def _unhashable(rows):
    try:
        hash(rows[0]) if rows else None
    except TypeError:
        return True
    return False


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from policyflow.plans import ORACLES, QUERIES

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    wanted = sys.argv[1:] or list(QUERIES)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            error = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
        except Exception as e:  # report and go on
            error = f"{type(e).__name__}: {str(e)[:900]}"
        bad += bool(error)
        print(f"{name:14s} {time.time() - start:6.2f}s {'ok' if not error else 'FAIL ' + error}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    sys.exit(bool(bad))
