"""Run registered queries in Spark and their SQL in DuckDB on the same tables and compare the rows.

    python tests/check_oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry_point  # noqa: E402
from stackloom.session import build_session  # noqa: E402


def plain(value):
    if value is None:
        return "\0"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat(" ")
    if isinstance(value, (float, decimal.Decimal, int)):
        number = float(value)
        if math.isfinite(number) and number == int(number) and abs(number) < 2**53:
            return str(int(number))
        return repr(value if isinstance(value, int) else round(number, 9))
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, connection, sf_dir, name, build, sql):
    frame = build(spark, sf_dir)
    got_columns, got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return f"rows only ({len(got)})" if got else "EMPTY"
    result = connection.sql(sql)
    want_columns, want = canonical(result.columns, result.fetchall())
    if got_columns != want_columns:
        return f"COLUMNS {got_columns} != {want_columns}"
    if got != want:
        extra = sorted(set(got) - set(want))[:3]
        lack = sorted(set(want) - set(got))[:3]
        return f"ROWS {len(got)} != {len(want)}\n   spark only {extra}\n   sql only   {lack}"
    return f"ok ({len(got)})" if got else "EMPTY"


def open_tables(sf_dir):
    connection = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        if file.endswith(".parquet"):
            connection.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf_dir}/{file}'")
    return connection


if __name__ == "__main__":
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    session = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    tables = open_tables(folder)
    oracles = entry_point.oracle_sql()
    bad = []
    for key, callable_ in entry_point.queries().items():
        if args.names and not any(n in key for n in args.names):
            continue
        began = time.time()
        try:
            verdict = compare(session, tables, folder, key, callable_, oracles.get(key))
        except Exception as error:  # report and go on
            verdict = "ERROR " + "".join(traceback.format_exception_only(error))[:1500]
        print(f"{time.time() - began:6.1f}s {key}: {verdict}", flush=True)
        if not verdict.startswith(("ok", "rows only")):
            bad.append(key)
    print("BAD:", bad)
