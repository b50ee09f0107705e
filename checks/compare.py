"""Run registered queries against their SQL and report differences.

    python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

from checks import ORACLES, QUERIES
from veritable import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    return float(value) if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)) else value


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    """Columns by name, rows in a fixed order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    got = canonical(df.columns, [tuple(row) for row in df.collect()])
    result = con.execute(sql)
    want = canonical([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} instead of {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows instead of {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if repr(a) != repr(b):
            return f"row {a} instead of {b}"
    return None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    failed = 0
    for name in chosen:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            problem = difference(df, con, ORACLES[name]) if name in ORACLES else f"rows only: {df.count()}"
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += bool(problem) and name in ORACLES
        print(f"{'ok' if not problem else 'DIFF' if name in ORACLES else '--'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(chosen)} queries, {failed} differ")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
