"""Run registered queries in Spark and their SQL twins in DuckDB and
compare row count, column names and an order-insensitive value hash.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return _norm(tuple(v))
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if v is None:
        return "NULL"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, sf_dir, names=None, verbose=True):
    from tastemill.plans import load_all
    reg = load_all()
    con = duck(sf_dir)
    out = {}
    for name, q in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = q.build(spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            out[name] = ("spark-error", repr(e)[:400])
            if verbose:
                print(name, "SPARK ERROR", repr(e)[:400], flush=True)
            continue
        ts = time.time() - t0
        if q.sql is None:
            out[name] = ("rows-only", len(srows))
            if verbose:
                print(f"{name}: rows-only {len(srows)} rows {ts:.1f}s", flush=True)
            continue
        try:
            res = con.execute(q.sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            out[name] = ("sql-error", repr(e)[:400])
            if verbose:
                print(name, "SQL ERROR", repr(e)[:400], flush=True)
            continue
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        ok = (sorted(scols) == sorted(dcols)) and len(srows) == len(drows) and hs == hd
        out[name] = ("ok" if ok else "MISMATCH", len(srows), len(drows))
        if verbose:
            print(f"{name}: {'ok' if ok else 'MISMATCH'} spark={len(srows)} sql={len(drows)} {ts:.1f}s",
                  flush=True)
            if not ok:
                print("  cols", sorted(scols), sorted(dcols))
                a, b = set(ls), set(ld)
                print("  only spark:", sorted(a - b)[:3])
                print("  only sql  :", sorted(b - a)[:3])
    return out


if __name__ == "__main__":
    from tastemill.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("ok", "rows-only")]
    print("SUMMARY", len(res), "queries,", len(bad), "bad:", bad)
