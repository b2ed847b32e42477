"""Local correctness loop: run each registered Spark query and its DuckDB
oracle on the same parquet tables and compare columns, row counts and
order-insensitive values (doubles rounded to 6 places).

usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from aidsift.plans.registry import load_all  # noqa: E402
from aidsift.session import local_session  # noqa: E402
from aidsift.sources.tables import TABLES  # noqa: E402


def canon(v):
    if v is None:
        return ("~",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("~",)
        return ("n", round(v, 6) + 0.0)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("n", float(v))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return ("l", tuple(canon(x) for x in v))
    if isinstance(v, dict):
        return ("d", tuple(sorted((k, canon(x)) for k, x in v.items())))
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    return ("s", str(v))


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in records), key=repr)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    con.execute("SET TimeZone='UTC'")
    qs = load_all()
    bad = 0
    for name, (fn, sql) in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if sql is None:
            print(f"rows {name}: {len(srows)} rows ({dt:.1f}s, no oracle)")
            continue
        try:
            cur = con.execute(sql)
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(ocols):
            print(f"FAIL {name}: columns spark={scols} oracle={ocols}")
            bad += 1
            continue
        a, b = rows_of(scols, srows), rows_of(ocols, orows)
        if len(a) != len(b):
            print(f"FAIL {name}: rows spark={len(a)} oracle={len(b)}")
            bad += 1
            continue
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            sa, sb = set(a), set(b)
            print(f"FAIL {name}: values differ ({len(sa - sb)} spark-only rows) e.g. "
                  f"{str(list(sa - sb)[:2])[:600]} vs {str(list(sb - sa)[:2])[:600]}")
            bad += 1
            continue
        print(f"ok   {name}: {len(a)} rows ({dt:.1f}s)")
    print(f"done, {bad} failing")
    spark.stop()


if __name__ == "__main__":
    main()
