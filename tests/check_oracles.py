"""Run registered queries and their oracle SQL side by side: python tests/check_oracles.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry
from plantspark.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows_of(cursor_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in cursor_rows)


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, name, sf_dir, queries, oracles):
    start = time.time()
    df = queries[name](spark, sf_dir)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    seconds = time.time() - start
    if name not in oracles:
        return "rows", len(got), seconds, ""
    cursor = con.execute(oracles[name])
    columns = [d[0] for d in cursor.description]
    want = rows_of(cursor.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return "COLUMNS", len(got), seconds, f"{sorted(df.columns)} / {sorted(columns)}"
    if got == want:
        return "ok" if got else "EMPTY", len(got), seconds, ""
    extra, missing = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
    return "DIFF", len(got), seconds, f"want {len(want)}\n   spark only {extra}\n   oracle only {missing}"


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(n.startswith(a) for a in args)]
    spark, con = local_session(), oracle_connection(sf_dir)
    bad, total = [], 0.0
    for name in names:
        try:
            state, n, seconds, note = compare(spark, con, name, sf_dir, queries, oracles)
        except Exception as error:  # report and go on with the next query
            state, n, seconds, note = "ERROR", 0, 0.0, str(error)[:600]
        total += seconds
        if state not in ("ok", "rows"):
            bad.append(name)
        print(f"RESULT {state:8} {name:40} {n:7} rows {seconds:6.2f}s {note}", flush=True)
    print(f"RESULT total {len(names)} queries, {len(bad)} bad, {total:.0f}s: {bad}")
    return bool(bad)


if __name__ == "__main__":
    raise SystemExit(main())
