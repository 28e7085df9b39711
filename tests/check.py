"""Compare queries with their SQL twins: ``python tests/check.py [sf] [name prefix ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if value != value else (0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(normal(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cursor = con.execute(sql)
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())


def compare(df, con, sql) -> str:
    names = sorted(df.columns)
    cursor = con.execute(sql)
    other = sorted(d[0] for d in cursor.description)
    if names != other:
        return f"columns differ: {set(names) ^ set(other)}"
    b = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    a = spark_rows(df)
    if len(a) != len(b):
        return f"row counts differ: {len(a)} and {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        x, y = wrong[0]
        cells = [(names[i], p, q) for i, (p, q) in enumerate(zip(x, y)) if p != q]
        return f"{len(wrong)} of {len(a)} rows differ, first: {cells[:4]}"
    return f"ok {len(a)} rows" if a else "ok but EMPTY"


def main() -> None:
    import __spark_entry__ as entry
    from regionwatch.session import local_session

    args = sys.argv[1:] or ["0.01"]
    folder, prefixes = f"/root/testdata/sf{args[0]}", tuple(args[1:])
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            said = compare(df, con, oracles[name]) if name in oracles else f"rows only: {len(df.collect())}"
        except Exception as exc:  # report and go on with the next query
            said = f"ERROR {type(exc).__name__}: {str(exc)[:300]}"
        if not said.startswith(("ok ", "rows only")) or "EMPTY" in said:
            bad.append(name)
        print(f"{name:32s} {time.time() - start:6.1f}s  {said}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
