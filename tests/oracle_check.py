"""Run registered Spark queries next to their DuckDB oracles and compare the results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: OK / MISMATCH / ERROR with row counts.
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}") if not os.environ.get("EXACT") else v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        s = v.isoformat()
        return s[:10] if s.endswith("T00:00:00") else s
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: repr(t))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    if sql is None:
        return f"ROWS-ONLY {name}: spark={len(srows)} ({t1 - t0:.1f}s)"
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    if sorted(scols) != sorted(dcols):
        return f"SCHEMA {name}: spark={scols} duck={dcols}"
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a == b:
        return f"OK {name}: rows={len(a)} ({t1 - t0:.1f}s)"
    sa, sb = set(a), set(b)
    ex_a = [r for r in a if r not in sb][:3]
    ex_b = [r for r in b if r not in sa][:3]
    return (f"MISMATCH {name}: spark={len(a)} duck={len(b)} cols={sorted(scols)}\n  spark-only: {ex_a}\n"
            f"  duck-only: {ex_b}")


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from shelfspark.session import build_session
    import __spark_entry__ as E
    spark = build_session()
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            msg = compare(spark, con, name, fn, os_.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            msg = f"ERROR {name}: {type(e).__name__}: " + " | ".join([l for l in str(e).splitlines() if l.strip()][-3:])[:600]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if not (msg.startswith("OK") or msg.startswith("ROWS-ONLY")):
            bad += 1
        print(msg, flush=True)
    print(f"done: {len([n for n in qs if not names or n in names])} queries, {bad} not OK")


if __name__ == "__main__":
    main()
