"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tools/check_oracle.py [sf_dir] [key ...]
Compares row count, column names and an order-insensitive value multiset
(doubles rounded to 9 places).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from labelflow.plans import catalog  # noqa: E402
from labelflow.session import local_session  # noqa: E402
from labelflow.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in records:
        out.append(tuple(norm(r[i]) for i in order))
    return sorted(out, key=repr)


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.001"
    keys = [a for a in args if not os.path.isdir(a)]
    catalog.load_all()
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    todo = keys or sorted(catalog.QUERIES)
    bad = 0
    for k in todo:
        t0 = time.time()
        try:
            df = catalog.QUERIES[k](spark, sf_dir)
            srows = df.collect()
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = catalog.ORACLE.get(k)
        if sql is None:
            print(f"ROWS {k}: {len(srows)} rows ({ts:.1f}s) cols={scols}")
            continue
        try:
            res = con.execute(sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {k}: columns spark={scols} duck={dcols}")
            bad += 1
            continue
        a = rows_of(scols, [tuple(r) for r in srows])
        b = rows_of(dcols, drows)
        if a != b:
            sa, sb = set(a), set(b)
            print(f"FAIL {k}: rows spark={len(a)} duck={len(b)}; only spark {list(sa - sb)[:3]}; "
                  f"only duck {list(sb - sa)[:3]}")
            bad += 1
        else:
            print(f"OK   {k}: {len(a)} rows ({ts:.1f}s)")
    print(f"{len(todo) - bad}/{len(todo)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
