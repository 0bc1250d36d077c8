"""Compares registered queries with their SQL on the same parquet tables.

Usage: python -m tests.oracle [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(repr(value)) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def kind(value) -> str:
    return "float" if isinstance(value, (float, Decimal)) else type(value).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def compare(spark_df, con, sql: str) -> str:
    got, got_columns = rows_of(spark_df.columns, spark_df.collect())
    cursor = con.execute(sql)
    want, want_columns = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"values {str(a)[:400]} != {str(b)[:400]}"
    for i in range(len(got_columns)):
        a = next((kind(r[i]) for r in got if r[i] is not None), None)
        b = next((kind(r[i]) for r in want if r[i] is not None), None)
        if a != b:
            return f"type of {got_columns[i]}: {a} != {b}"
    return ""


def main() -> int:
    import importlib.util

    from tests.conftest import make_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    loader = importlib.util.spec_from_file_location("spark_entry", "__spark_entry__.py")
    entry = importlib.util.module_from_spec(loader)
    loader.loader.exec_module(entry)
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark = make_session()
    con = connect(sf_dir)
    failures = 0
    for name, query in queries.items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            frame = query(spark, sf_dir)
            if name in oracles:
                problem = compare(frame, con, oracles[name])
                status = "MISMATCH " + problem if problem else "ok"
            else:
                status = f"rows-only ({len(frame.collect())} rows)"
        except Exception as error:  # noqa: BLE001 - the report lists every failing query
            status = "ERROR " + str(error)[:600]
            if len(args) == 1:
                traceback.print_exc()
        failures += status.startswith(("MISMATCH", "ERROR"))
        print(f"{name:45s} {time.time() - start:6.1f}s {status}", flush=True)
    print("failures:", failures, "queries:", len(queries), "oracles:", len(oracles))
    return failures


if __name__ == "__main__":
    sys.exit(bool(main()))
