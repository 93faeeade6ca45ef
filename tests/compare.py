"""Runs queries on Spark and their SQL on DuckDB over the same tables and compares rows: python tests/compare.py DIR [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    return v if isinstance(v, int | str) else str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_rows: tuple[list[str], list], duck_rows: tuple[list[str], list]) -> str:
    if sorted(spark_rows[0]) != sorted(duck_rows[0]):
        return f"columns {sorted(spark_rows[0])} {sorted(duck_rows[0])}"
    a, b = rows_of(*spark_rows), rows_of(*duck_rows)
    if a == b:
        return ""
    only_a, only_b = list(set(a) - set(b))[:3], list(set(b) - set(a))[:3]
    return f"rows {len(a)} {len(b)}; spark only {only_a}; sql only {only_b}"


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, sql, c, bad = entry.queries(), entry.oracle_sql(), connect(sf_dir), 0
    for name in names or list(queries):
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = df.columns, [tuple(r) for r in df.collect()]
            took = time.time() - began
            said = "no sql"
            if name in sql:
                rel = c.sql(sql[name])
                said = differences(got, (list(rel.columns), rel.fetchall())) or "ok"
        except Exception as e:
            said, got, took = f"error {type(e).__name__}: {str(e)[:600]}", ([], []), time.time() - began
            if "-v" in os.environ.get("COMPARE", ""):
                traceback.print_exc()
        bad += said not in ("ok", "no sql")
        print(f"{name}: {took:.1f} s, {len(got[1])} rows, {said[:900]}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
