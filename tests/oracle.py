"""Side-by-side check of registered queries against DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, name, query, sql, sf_dir):
    """(ok, message, seconds)."""
    t = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    took = time.time() - t
    if sql is None:
        return len(got) > 0, f"rows={len(got)}", took
    t = time.time()
    cur = duck(sf_dir).execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - t
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}", took
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return len(a) > 0, f"rows={len(a)} sql={sql_took:.1f}s", took
    sa, sb = set(a), set(b)
    return (
        False,
        f"rows {len(a)} vs {len(b)}; only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]}",
        took,
    )


def main():
    from runlens.queries import all_queries, all_sql
    from runlens.session import build_session

    sf_dir = sys.argv[1]
    names = sys.argv[2:]
    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = all_queries(), all_sql()
    bad = 0
    for name in names or queries:
        try:
            ok, msg, took = compare(spark, name, queries[name], sql.get(name), sf_dir)
        except Exception as e:  # report and go on
            ok, msg, took = False, f"{type(e).__name__}: {str(e)[:600]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:24s} {took:6.2f}s {'' if name in sql else '(no sql) '}{msg}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
