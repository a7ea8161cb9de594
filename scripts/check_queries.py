"""Run the registered queries next to their SQL twins in DuckDB and report differences and seconds.

usage: check_queries.py [sf_dir] [name-part ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mesograph.queries import all_queries, all_sql  # noqa: E402
from mesograph.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
                                                   "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    sqls = all_sql()
    bad = 0
    for name, fn in all_queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            got = df.collect()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
            continue
        took = time.time() - t0
        if name not in sqls:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s {df.dtypes}", flush=True)
            continue
        t0 = time.time()
        try:
            cur = con.execute(sqls[name])
            names, types, want = [d[0] for d in cur.description], [str(d[1]) for d in cur.description], cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"SQLERR {name}: {str(e)[:800]}", flush=True)
            continue
        dtook = time.time() - t0
        a, b = rows_of(df.columns, got), rows_of(names, want)
        same = a == b
        bad += not same
        print(f"{'ok   ' if same else 'DIFF '} {name}: {len(got)}/{len(want)} rows {took:.1f}s (duckdb {dtook:.1f}s)", flush=True)
        kinds = dict(zip(names, types))
        short = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        for c, t in df.dtypes:
            if short.get(t, t) != kinds.get(c):
                print(f"      type {c}: spark {t} duckdb {kinds.get(c)}")
        if not same:
            print("      columns", a[0], b[0])
            in_a, in_b = set(a[1]), set(b[1])
            only_a, only_b = [r for r in a[1] if r not in in_b], [r for r in b[1] if r not in in_a]
            print("      differing rows", len(only_a), len(only_b))
            for r in only_a[:4]:
                print("      spark ", r)
            for r in only_b[:4]:
                print("      duckdb", r)
    print("failures:", bad)


main()
