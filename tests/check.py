"""Run registered queries beside their SQL twins and report differences.

python tests/check.py [--sf DIR] [prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name, sf_dir, entry):
    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    took = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"ROWS  {name} rows={len(got)} {took:.1f}s", True
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"COLS  {name} {sorted(df.columns)} != {sorted(want_cols)}", False
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:3]
        only_b = [x for x in b if x not in set(a)][:3]
        return (f"DIFF  {name} rows {len(a)} vs {len(b)} cols={sorted(df.columns)}\n"
                f"   spark {only_a}\n   duck  {only_b}"), False
    return f"OK    {name} rows={len(a)} {took:.1f}s", True


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("prefix", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from tapeloom.session import build_session

    spark = build_session("check", "local[8]", 8, {
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
        "spark.sql.ui.explainMode": "formatted"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name in entry.queries():
        if args.prefix and not any(name.startswith(p) for p in args.prefix):
            continue
        try:
            line, ok = compare(spark, con, name, args.sf, entry)
        except Exception as exc:  # noqa: BLE001
            line, ok = f"ERROR {name} {type(exc).__name__}: {str(exc)[:900]}", False
        bad += not ok
        print(line, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
