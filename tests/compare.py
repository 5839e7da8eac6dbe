"""Run registered queries and their SQL side by side.

``python -m tests.compare [sf_dir] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import contextlib
import io
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        number = float(value)
        return None if math.isnan(number) else number
    return str(value)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(cells, key=repr), [columns[i] for i in order]


def spark_rows(df):
    return _sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return _sorted_rows(columns, cursor.fetchall())


def difference(got, want) -> str:
    """Empty when equal, else a short description."""
    (rows_a, cols_a), (rows_b, cols_b) = got, want
    if cols_a != cols_b:
        return f"columns {cols_a} != {cols_b}"
    if len(rows_a) != len(rows_b):
        return f"{len(rows_a)} rows != {len(rows_b)}"
    bad = [(a, b) for a, b in zip(rows_a, rows_b) if a != b]
    return f"{len(bad)} of {len(rows_a)} rows differ, first {bad[0]}" if bad else ""


def explained(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def main(argv: list[str]) -> int:
    from harvestlens.plans.catalog import ORACLES, QUERIES
    from harvestlens.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con = local_session(), database(sf_dir)
    failed = 0
    for name in names:
        started = time.time()
        try:
            got = spark_rows(QUERIES[name](spark, sf_dir))
            took = time.time() - started
            verdict = "rows only"
            if name in ORACLES:
                verdict = difference(got, sql_rows(con, ORACLES[name])) or "ok"
        except Exception as e:
            got, took, verdict = ([], []), time.time() - started, f"{type(e).__name__}: {e}"[:1500]
        failed += verdict not in ("ok", "rows only")
        print(f"{name:40s} {len(got[0]):7d} rows {took:6.2f}s  {verdict}", flush=True)
    print(f"{failed} of {len(names)} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
