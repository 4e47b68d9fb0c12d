"""Compare registered queries with their SQL counterparts: python tests/oracle.py [sf_dir] [key ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canon(value):
    """Comparable form of a cell of either engine."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return None if isinstance(value, float) and math.isnan(value) else round(float(value), 6)
    if hasattr(value, "asDict"):
        return tuple(canon(v) for v in value)
    if isinstance(value, dict):
        return tuple(canon(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir, key, query, sql):
    """(ok, spark rows, message)"""
    df = query(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return len(got) > 0, len(got), "rows only"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, len(got), f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, len(got), "match"
    sa, sb = set(a), set(b)
    gone = [r for r in b if r not in sa][:3]
    extra = [r for r in a if r not in sb][:3]
    return False, len(got), f"{len(a)} vs {len(b)} rows; only spark {extra}; only sql {gone}"


def main():
    import __spark_entry__ as entry
    from evigraph.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = local_session(8), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in args or queries:
        if key.endswith(".py"):
            continue
        t = time.time()
        try:
            ok, n, message = compare(spark, con, sf_dir, key, queries[key], oracles.get(key))
        except Exception as exc:  # report and go on with the next key
            ok, n, message = False, -1, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {key:32s} {n:8d} rows {time.time() - t:6.1f}s {message}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
