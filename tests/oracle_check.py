"""Run every named query beside its SQL counterpart and compare whole results.

``python tests/oracle_check.py [folder] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None:
        return (0, str(value))
    if isinstance(value, float):
        return (1, "nan") if math.isnan(value) else (1, repr(round(value, 9) + 0.0))
    if isinstance(value, int):
        return (2, str(value))
    return (3, str(value))


def _rows(columns: list[str], rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_plain(row[i]) for i in order) for row in rows])


def differences(frame, result) -> list[str]:
    """Human-readable differences between a Spark DataFrame and an SQL relation; empty if equal."""
    ours, theirs = list(frame.columns), list(result.columns)
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} != {sorted(theirs)}"]
    kinds = {c: t for c, t in frame.dtypes}
    other = {c: str(t) for c, t in zip(result.columns, result.types)}
    families = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    found = [f"type of {c}: {kinds[c]} != {other[c]}" for c in ours if families.get(kinds[c], kinds[c]) != other[c]]
    left, right = _rows(ours, frame.collect()), _rows(theirs, result.fetchall())
    if len(left) != len(right):
        found.append(f"rows {len(left)} != {len(right)}")
    if left != right:
        a, b = set(left), set(right)
        found.append(f"values differ: only spark {sorted(a - b)[:2]} only sql {sorted(b - a)[:2]} ({len(a - b)}/{len(b - a)})")
    return found


def main(folder: str, names: list[str]) -> int:
    from diffloom.session import build_session
    from __spark_entry__ import oracle_sql, queries

    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = open_tables(folder)
    statements, failed = oracle_sql(), 0
    for name, make in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            frame = make(spark, folder)
            if name not in statements:
                outcome = [] if frame.count() else ["no rows"]
            else:
                outcome = differences(frame, connection.sql(statements[name]))
        except Exception as error:  # report and go on with the next query
            outcome = [f"{type(error).__name__}: {str(error)[:700]}"]
        failed += bool(outcome)
        print(f"{'ok  ' if not outcome else 'FAIL'} {name} {time.time() - start:.1f}s {'; '.join(outcome)[:1500]}", flush=True)
    print("unmatched sql:", sorted(set(statements) - set(queries())))
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    target = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(1 if main(target, sys.argv[2:]) else 0)
