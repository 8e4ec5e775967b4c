"""Runs queries and their oracle SQL side by side: ``python -m tests.oracle [folder] [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


_KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def compare(spark, con, name, query, sql, folder) -> str:
    """An empty string if both agree."""
    df = query(spark, folder)
    got = rows(df.columns, df.collect())
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    kinds = {d[0]: str(d[1]) for d in found.description}
    want = rows(columns, found.fetchall())
    types = [f"{c}: {t} for {kinds.get(c)}" for c, t in df.dtypes if _KINDS.get(kinds.get(c, ""), kinds.get(c)) != t]
    if got[0] != want[0]:
        return f"columns {got[0]} for {want[0]}"
    if got[1] != want[1]:
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        return f"{len(got[1])} rows for {len(want[1])}; only here {sorted(a - b)[:2]}; only in SQL {sorted(b - a)[:2]}"
    return f"types {types}" if types else ""


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master(os.environ.get("ORACLE_MASTER", "local[8]")).config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, bad = connect(folder), entry.queries(), 0
    for name, sql in entry.oracle_sql().items():
        if argv[1:] and name not in argv[1:]:
            continue
        try:
            problem = compare(spark, con, name, queries[name], sql, folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(problem)
        print(f"{name}: {problem or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
