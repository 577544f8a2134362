"""Runs registered queries in Spark and their SQL in DuckDB, and compares whole results."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return type(value).__name__


def row_bag(rows, order) -> Counter:
    return Counter(tuple(row[i] for i in order) for row in rows)


def compare(df, con, sql: str) -> str:
    """Empty when equal, else a short description of the first differences."""
    res = con.execute(sql)
    duck_cols = [c[0] for c in res.description]
    theirs = res.fetchall()
    ours = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(duck_cols):
        return f"columns {sorted(df.columns)} vs {sorted(duck_cols)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    if not ours:
        return "empty"
    names = sorted(duck_cols)
    a = row_bag(ours, [df.columns.index(n) for n in names])
    b = row_bag(theirs, [duck_cols.index(n) for n in names])
    for i, n in enumerate(names):
        ka = {kind(r[i]) for r in a} - {"null"}
        kb = {kind(r[i]) for r in b} - {"null"}
        if ka and kb and ka != kb:
            return f"type of {n}: {ka} vs {kb}"
    if a == b:
        return ""
    only_a, only_b = a - b, b - a
    return f"{sum(only_a.values())} rows differ, e.g. {str(next(iter(only_a)))[:300]} vs {str(next(iter(only_b)))[:300]}"


def main() -> int:
    from claimforge.session import build_session
    from queries import CHECKS, QUERIES

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = run(spark, sf)
            note = compare(df, con, CHECKS[name]) if name in CHECKS else f"rows only: {df.count()}"
        except Exception as e:  # report and go on
            note = "ERROR " + str(e).strip()[:600]
        ok = note == "" or note.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - t:6.2f}s {name} {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
